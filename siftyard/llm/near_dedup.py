"""Near-duplicate groups by HyperMinHash.

Steps: (1) one row per different text; (2) its set of distinct word shingles as 64-bit hashes, split by their top bits
over 128 buckets; a register keeps the leading zeros (6 bits) and ten mantissa bits of the bucket's least value; empty
registers borrow from others in an order fixed for each (optimal densification); (3) texts with one set are one node;
(4) four registers are a band, 32 bands; nodes that share a band meet; (5) in each band's bucket the most central node is
the hub, and every other node is compared with it: first by the collision-corrected Jaccard estimate of the registers,
then on the full sets; (6) components; (7) whatever met and is in different components still is compared, block by block, so
that no link is lost to the choice of hubs; (8) components again.

A band is missed by a pair of similarity 0.8 with probability (1 - 0.8**4)**32 = 5e-8. The estimate drops pairs below
the threshold less five standard errors. Sets are compared as sets of 64-bit hashes of whole shingles.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing: component_id is the row's own
doc_id. A text of fewer words than a shingle is one shingle. Rows that repeat an id get the component of their text.
Null ids do not count for the smallest id; a component without any id has a null component_id, and its rows are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import distinct_texts, read, shared_dir, text_id, tidy, utf8, written
from siftyard.llm.hashing import mix, signed, word_hashes

SHINGLE, PERCENT = 5, 80
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: Chance that two registers of different values agree: they do on the zeros and the mantissa.
COLLIDE = 0.0007
#: Standard errors below the threshold down to which the estimate lets pairs pass.
MARGIN = 5
#: Shingles of the sets that a block of a star holds.
BLOCK_SHINGLES = 150_000
#: Parts that the rows of a hub are dealt in where they meet what is known of it.
SALTS = 16
_U = np.uint64
_PROBES = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=_U)).reshape(REGISTERS, REGISTERS), axis=1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, _U)
    w, k = word_hashes(words), min(n, len(words))
    h = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def registers(h: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (16 bits each) of a sorted set of hashes; not empty."""
    bits = 64 - (REGISTERS - 1).bit_length()
    bucket = (h >> _U(bits)).astype(np.int64)
    first = np.nonzero(np.diff(bucket, prepend=-1))[0]
    v = h[first] & _U((1 << bits) - 1)
    zeros = (53 - np.frexp((v >> _U(bits - 53)).astype(np.float64))[1]).astype(_U)
    mantissa = ((v << (zeros + _U(1))) & _U((1 << bits) - 1)) >> _U(bits - 10)
    out, full = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[bucket[first]] = (zeros << _U(10) | mantissa).astype(np.uint16)
    full[bucket[first]] = True
    if not full.all():
        empty = np.nonzero(~full)[0]
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), full[probes].argmax(1)]]
    return out


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """tid, doc_id, n_shingles, sig_hi, sig_lo (of the set), bands (four registers in each long)."""

    def run(batches):
        for batch in batches:
            size, hi, lo, bands = [], [], [], []
            for text in utf8(batch, "text"):
                h = shingles(text, n)
                size.append(len(h))
                sig = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                hi.append(int(sig[0]))
                lo.append(int(sig[1]))
                bands.append(registers(h).view(np.int64) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["tid", "doc_id", "n_shingles", "sig_hi", "sig_lo", "bands"],
            )

    schema = "tid binary, doc_id long, n_shingles long, sig_hi long, sig_lo long, bands array<long>"
    return texts.select("tid", "doc_id", "text").mapInArrow(run, schema)


def sets(texts: DataFrame, n: int) -> DataFrame:
    """node, set: the full sets of the texts that are compared."""

    def run(batches):
        for batch in batches:
            out = [signed(shingles(x, n)) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.list_(pa.int64()))], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node of `edges` (a, b), by alternating large and small stars.
    Every round ends in a checkpoint; nothing but two sums comes to the driver."""
    spark = edges.sparkSession
    shared_dir(spark)
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    state = None
    while True:
        tidy(spark)
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(told) == state or not told[0]:
            return now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("comp")), F.struct(F.col("b").alias("node"), F.col("b").alias("comp")))).alias("x")).select("x.*").distinct()
        state = tuple(told)
        now = _stars(now).checkpoint()


def _stars(now: DataFrame) -> DataFrame:
    """One round: edges (a > b) of a large star, then of a small star. Both ends of an edge come from one explode, not from a
    union, so that the plan reads `now` four times instead of sixteen: plans are what fills the driver's memory."""
    ends = lambda *x: F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in x])).alias("x")
    both = now.select(ends(("a", "b"), ("b", "a"))).select("x.*")
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    return large.join(least, F.col("a") == F.col("u")).select(ends(("a", "m"), ("b", "m"))).select("x.*").filter("a <> b").distinct()


def _estimate(a, b):
    """Collision-corrected Jaccard estimate of two arrays of bands."""
    lanes = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    same = F.aggregate(lanes, F.lit(0), lambda n, x: n + sum((F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int") for k in range(4)))
    return (same / F.lit(float(REGISTERS)) - COLLIDE) / (1 - COLLIDE)


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked for."""
    j = percent / 100
    least = j - MARGIN * math.sqrt(j * (1 - j) / REGISTERS)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    near = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .filter(_estimate(F.col("bands_a"), F.col("bands_b")) >= least).select("a", "b", "n_a", "n_b")
    )
    near = _step(near, "pairs")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    full = sets(texts.join(nodes.join(wanted, "node").select("node", "tid"), "tid"), n)
    full = _step(full, "sets")
    both = near.join(full.withColumnRenamed("node", "a").withColumnRenamed("set", "set_a"), "a").join(
        full.withColumnRenamed("node", "b").withColumnRenamed("set", "set_b"), "b"
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * percent).select("a", "b")


def _between(pairs: DataFrame, first: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among nodes that have met.

    Nodes that met in a bucket both belong to the star of the bucket's hub, so all pairs of a star cover all pairs that
    met, with a node in a few stars instead of 32 buckets. In a star of several components the members outside its
    largest one (x) are compared with each other and with the largest one (y). Both are dealt by hash into blocks of
    about BLOCK_SHINGLES, and pairs of blocks are what a task holds at once: every set travels once for each block it
    meets, not once for each pair, and only links come out."""
    star = pairs.select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(pairs.select(F.col("a").alias("hub"), F.col("a").alias("node")).distinct())
    sized = nodes.select("node", "tid", F.col("n_shingles").alias("n"))
    star = star.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(sized, "node")
    share = star.groupBy("hub", "comp").agg(F.sum("n").alias("n"))
    main = share.groupBy("hub").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("comps"))
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / BLOCK_SHINGLES)).cast("int")
    main = main.filter("comps > 1").select("hub", "main", blocks(F.col("all") - F.col("most")).alias("nx"), blocks(F.col("most")).alias("ny"))
    # a hub's rows are dealt by hub and salt, so that a large star does not come together in one task
    main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    star = star.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    placed = star.join(main.hint("merge"), ["hub", "salt"]).drop("salt").withColumn("is_x", F.col("comp") != F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_x"), F.col("nx")).otherwise(F.col("ny"))).cast("int"))
    wanted = placed.select("node", "tid").distinct()
    full = _step(sets(texts.join(wanted, "tid"), n), "sets")
    # blocks are numbered x first; a pair of blocks is (i, j) with i <= j and i an x block
    xs = F.sequence(F.lit(0), F.col("nx") - 1)
    as_x = F.transform(F.sequence(F.lit(0), F.col("nx") + F.col("ny") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (k < F.col("own")).alias("right")))
    as_y = F.transform(xs, lambda k: F.struct(k.alias("i"), (F.col("own") + F.col("nx")).alias("j"), F.lit(True).alias("right")))
    dealt = placed.select("hub", "node", "comp", F.explode(F.when(F.col("is_x"), as_x).otherwise(as_y)).alias("at")).select("hub", "node", "comp", "at.*")

    def compare(table: pa.Table) -> pa.Table:
        node, comp, right = (table.column(k).to_numpy() for k in ("node", "comp", "right"))
        own = [np.asarray(x) for x in table.column("set").combine_chunks().to_numpy(zero_copy_only=False)]
        left, other = np.nonzero(~right)[0], np.nonzero(right)[0]
        if table.column("i")[0] == table.column("j")[0]:
            other = left
        out: list[tuple[int, int]] = []
        if len(left) and len(other):
            size = np.array([len(own[k]) for k in other])
            owner = np.repeat(np.arange(len(other)), size)
            values = np.concatenate([own[k] for k in other])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for k in left:
                lo, hi = np.searchsorted(values, own[k], "left"), np.searchsorted(values, own[k], "right")
                hit = hi > lo
                lo, count = lo[hit], (hi - lo)[hit]
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                shared = np.bincount(owner[at], minlength=len(other))
                ok = (shared * 100 >= (len(own[k]) + size - shared) * percent) & (comp[other] != comp[k])
                best = np.nonzero(ok)[0]
                out += [(int(node[k]), int(node[other[i]])) for i in best[np.unique(comp[other][best], return_index=True)[1]]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return dealt.join(full, "node").groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _step(df: DataFrame, name: str) -> DataFrame:
    """`written`, and what it took on the driver is given back: the next plan starts from a table, not from this one."""
    found = written(df, name)
    tidy(df.sparkSession)
    return found


def near_duplicates(texts: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """tid, n_shingles, group (null for empty texts), component_id: one row for each row of `texts`, which is what
    `distinct_texts` gives."""
    every = _step(sketches(texts, n).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    some = every.filter("n_shingles > 0")
    nodes = some.groupBy("sig_hi", "sig_lo").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id"))
    member = some.join(nodes, ["sig_hi", "sig_lo"]).select("rid", "tid", "node", "least_id", "n_shingles", "bands")
    own = _step(member.filter("rid = node").drop("rid"), "nodes")

    band = own.select("node", F.posexplode("bands").alias("i", "x")).select(F.xxhash64("i", "x").alias("key"), "node")
    full = band.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    met = _step(band.join(full, "key"), "buckets")
    centre = met.groupBy("node").agg(F.sum("met").alias("weight"))
    ranked = met.join(centre, "node").select("key", "node", "weight")
    hubs = ranked.groupBy("key").agg(F.max_by("node", F.struct("weight", F.negative("node"))).alias("a"))
    pairs = _step(met.join(hubs, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "met")
    first = _step(components(_linked(pairs, own, texts, n, percent)), "first")

    late = _between(pairs, first, own, texts, n, percent)
    at = lambda side: first.select(F.col("node").alias(side), F.col("comp").alias(f"{side}c"))
    between = late.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    second = components(between)

    top = second.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    final = own.select("node").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(top, "comp", "left")
    final = final.select("node", F.coalesce("top", "comp").alias("group"))
    grouped = member.select("tid", "node", "least_id", "n_shingles").join(final, "node")
    least = grouped.groupBy("group").agg(F.min("least_id").alias("component_id"))
    out = grouped.join(least, "group").select("tid", "n_shingles", "group", "component_id")
    return out.unionByName(every.filter("n_shingles = 0").select("tid", "n_shingles", F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("component_id")))


def near_dedup(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(distinct_texts(docs, "near_texts"), n, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid")).join(found, "tid")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group, the one of the smallest non-null id (then by text id, then by a hash of the
    row); rows without a word are all kept.

    Texts are not shuffled again: what is decided on are the other columns, first one candidate for each text (copies
    meet on the map side), then one for each group, and the chosen rows fetch their text from the bucketed table."""
    texts = distinct_texts(docs, "near_texts")
    groups = near_duplicates(texts, n, percent).filter(F.col("group").isNotNull()).select("tid", "group")
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*others)
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").cast("long").alias("b"), F.xxhash64(F.to_json(row)).alias("c"))
    said = docs.filter(~wordless).select(text_id().alias("tid"), row.alias("row"), order.alias("order"))
    candidates = said.groupBy("tid").agg(F.min_by(F.struct("row", "order"), "order").alias("x")).select("tid", "x.*")
    rank = F.struct("order.a", "order.b", "tid", "order.c")
    best = candidates.join(groups, "tid").groupBy("group").agg(F.min_by(F.struct("tid", "row"), rank).alias("x")).select("x.*")
    kept = best.join(texts.select("tid", "text"), "tid")
    kept = kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.filter(wordless))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), n=2)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.k >= 80 * (p.n + q.n - c.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.a = n.doc_id
"""
