"""Secret scans, with DataFrame functions only: known forms, and a battery of randomness tests.

Base spans are places of known forms (an assignment to a secret's name, an access key id, a long hex string), leftmost
and non-overlapping per form. The method adds `random` spans: runs of 20 and more characters of common encodings that
are not inside a base span and

* look random: with the encoding inferred from the characters (hex, base 32, lower-case letters and digits, base 64),
  none of three tests rejects uniform symbols (chi-squared of the alphabet, runs above and below its middle, serial
  correlation; Bonferroni over the three);
* do not look like ordinary words: p is the chance that ordinary letters come as near to uniform as this, times the
  chance that ordinary text stays in the alphabet or changes between letters and digits as often. p is of the run's own
  length (length-aware), and Benjamini-Hochberg over the runs that the text has bounds the false discovery rate at
  `FDR`: how much other text stands around a run does not count.

Places are code points, end exclusive. They come from the lengths of matches and of what stands between them, as Spark
has no function for the places of all matches.

Edge cases: null and empty texts have no span. Repeated rows give a row each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import read

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 12
ALPHA, FDR = 0.002, 0.001
#: Sums of squared and cubed shares of letters in ordinary text.
LETTERS2, LETTERS3 = 0.066, 0.0055
#: Share of ordinary characters that are hex digits; chance of a change between letter and digit beside each other.
IN_HEX, CHANGE = 0.3, 0.3
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_FOUND = "array<struct<kind:int,start:int,end:int,found:string>>"
#: Matches whose places are summed together.
BLOCK = 64


def _let(value: Column, body) -> Column:
    """body(x) with x computed once."""
    return F.transform(F.array(value), body)[0]


def _zip_spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """(kind, start, end, found) of all matches; with `least`, of those whose second group has so many characters.

    Places are running sums, first inside blocks of BLOCK matches, then over the blocks: an array that grows by one match at
    a time would be copied as often as there are matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if least else 0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), values.alias("value"))
    none = F.array().cast(_FOUND)

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        own = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["found"].alias("found")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(s["out"], own)).otherwise(s["out"]).alias("out"))

    def block(x):
        return F.aggregate(x, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shifted(inner):
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(inner, empty, lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        moved = lambda x, base: F.transform(x["out"], lambda m: F.struct(m["kind"].alias("kind"), (m["start"] + base).alias("start"), (m["end"] + base).alias("end"), m["found"].alias("found")))
        return F.flatten(F.zip_with(inner, bases, moved))

    def whole(every):  # the last gap has no match after it
        n = F.size(every) - 1
        return _let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: block(F.slice(every, i * BLOCK + 1, F.least(F.lit(BLOCK), n - i * BLOCK)))), shifted)

    return F.when(text.rlike(pattern), _let(parts, whole)).otherwise(none)


def _cdf(z: Column) -> Column:
    """The normal distribution, by a logistic approximation (error below 0.0002)."""
    z = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.070566 * z * z * z))


def _tests(run: Column) -> Column:
    """struct<random, ordinary>: the chance of a run's characters under uniform symbols, and under ordinary text."""
    core = F.regexp_replace(run, "=+$", "")
    core = F.when(core == "", run).otherwise(core)  # nothing but padding

    def measured(s):
        hexa = s.rlike("^([0-9a-f]+|[0-9A-F]+)$")
        alphabet = (
            F.when(hexa, F.lit("0123456789abcdef")).when(s.rlike("^[A-Z2-7]+$"), F.lit("abcdefghijklmnopqrstuvwxyz234567"))
            .when(s.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), F.lit("0123456789abcdefghijklmnopqrstuvwxyz"))
            .otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
        )
        shown = F.when(F.length(alphabet) < 64, F.lower(s)).otherwise(F.translate(s, "-_=", "+//"))
        lost = lambda c: (F.length(shown) - F.length(F.replace(shown, c, F.lit("")))).cast("double")
        return F.struct(
            hexa.alias("hexa"), F.length(shown).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
            F.aggregate(F.array_distinct(F.split(shown, "")), F.lit(0.0), lambda a, c: a + lost(c) * lost(c)).alias("squares"),
            F.transform(F.split(shown, ""), lambda c: F.position(c, alphabet).cast("double")).alias("codes"),
            F.greatest(F.lit(0), F.length(F.regexp_replace(F.regexp_replace(s, "[0-9]+", "0"), "[^0]+", "a")) - 1).cast("double").alias("changes"),
        )

    def sums(x):
        n, k, codes = x["n"], x["k"], x["codes"]
        high = F.transform(codes, lambda c: c > k / 2)
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
        return F.struct(
            x.alias("x"), (k / n * x["squares"] - n).alias("chi"),
            F.size(F.filter(high, lambda b: b)).cast("double").alias("n1"),
            F.aggregate(F.zip_with(F.slice(high, 2, F.size(high)), high, lambda a, b: a != b), F.lit(1.0), lambda a, b: a + F.when(b, 1.0).otherwise(0.0)).alias("runs"),
            F.transform(codes, lambda c: c - mean).alias("off"),
        )

    def chances(y):
        x = y["x"]
        n, k, n1 = x["n"], x["k"], y["n1"]
        up = 2 * n1 * (n - n1) / n
        spread = F.sqrt(F.greatest(F.lit(0.0), up * (up - 1) / F.greatest(n - 1, F.lit(1.0))))
        z_runs = F.when(spread > 0, F.abs(y["runs"] - 1 - up) / spread).otherwise(9.0)
        square = F.aggregate(y["off"], F.lit(0.0), lambda a, c: a + c * c)
        lagged = F.aggregate(F.zip_with(F.slice(y["off"], 2, F.size(y["off"])), y["off"], lambda a, b: a * b), F.lit(0.0), lambda a, c: a + F.coalesce(c, F.lit(0.0)))
        z_serial = F.when(square > 0, F.abs(lagged / square) * F.sqrt(n)).otherwise(9.0)
        z_chi = (y["chi"] - (k - 1)) / F.sqrt(2 * (k - 1))
        random = F.least(F.lit(1.0), 3 * F.least(1 - _cdf(z_chi), 2 - 2 * _cdf(z_runs), 2 - 2 * _cdf(z_serial)))
        pairs = 2 * n * (n - 1) * (LETTERS2 - LETTERS2**2) + 4 * n * (n - 1) * (n - 2) * (LETTERS3 - LETTERS2**2)
        usual = k + k * (n - 1) * LETTERS2 - n
        ordinary = _cdf((y["chi"] - usual) / (k / n * F.sqrt(F.greatest(pairs, F.lit(1e-9)))))  # one character has no pairs
        ordinary = ordinary * F.when(x["hexa"], F.pow(F.lit(IN_HEX), n)).otherwise(F.pow(F.lit(CHANGE), x["changes"]))
        return F.struct(random.alias("random"), ordinary.alias("ordinary"))

    return _let(_let(_let(core, measured), sums), chances)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _random_spans(text: Column, base: Column) -> Column:
    """`random` spans outside the base spans, under false-discovery control over the text's runs."""

    def tested(s):
        return _let(_tests(s["found"]), lambda t: F.struct(s.alias("span"), t["random"].alias("random"), t["ordinary"].alias("p")))

    def chosen(x):
        corrected = F.array_sort(F.transform(x, lambda r: r["p"] * F.size(x)))
        limit = F.array_max(F.transform(corrected, lambda p, i: F.when(p <= FDR * (i + 1), p).otherwise(-1.0)))
        return _let(F.struct(limit.alias("limit"), F.size(x).alias("n")), lambda y: F.filter(x, lambda r: (r["p"] * y["n"] <= y["limit"]) & (r["random"] >= ALPHA)))

    found = _let(F.transform(_zip_spans(text, RUN, 3), tested), chosen)
    return _outside(F.transform(found, lambda r: r["span"]), base)


def _blocks(x: Column) -> Column:
    """An array (not empty) in blocks of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))


def _outside(runs: Column, base: Column) -> Column:
    """The runs that are not inside a base span: both in the order of their starts, held against the farthest end of the base
    spans before."""
    mark = lambda order: lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"))
    every = F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(runs, mark(1))))

    def step(s, x):
        own = F.array(F.struct(F.lit(3).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        shown = (x["order"] == 1) & (x["end"] > s["top"])
        return F.struct(F.when(x["order"] == 0, F.greatest(s["top"], x["end"])).otherwise(s["top"]).alias("top"), F.when(shown, F.concat(s["out"], own)).otherwise(s["out"]).alias("out"))

    def swept(blocks):
        tops = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, s: F.when(s["order"] == 0, F.greatest(a, s["end"])).otherwise(a)))
        before = F.aggregate(tops, F.array(F.lit(0)), lambda s, e: F.concat(s, F.array(F.greatest(F.element_at(s, -1), e))))
        return _let(before, lambda b: F.flatten(F.transform(blocks, lambda x, i: F.aggregate(x, F.struct(b[i].alias("top"), F.array().cast(_SPANS).alias("out")), step, lambda s: s["out"]))))

    return _let(every, lambda x: F.when(F.size(x) > 0, _let(_blocks(x), swept)).otherwise(F.array().cast(_SPANS)))


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with __base and __random: arrays of (kind, start, end). One narrow pass of JVM expressions."""
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.withColumn("__base", _bare(F.concat(_zip_spans(text, ASSIGN, 0, MIN_VALUE), _zip_spans(text, ACCESS, 1), _zip_spans(text, HEX, 2))))
    return rows.withColumn("__random", F.when(text.rlike(RUN), _random_spans(text, F.col("__base"))).otherwise(F.array().cast(_SPANS)))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_shown(F.col("__base")), 256).alias("base_sha256"), _shown(F.concat("__base", "__random")).alias("spans"),
        F.size("__random").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span in `text` replaced by `mark` (spans that overlap by one) and `__found` (bool); null texts stay
    null. Blocks of spans are cut from the text first, and the pieces between spans from these."""
    rows = find_secrets(docs)
    text = F.col("text")
    ordered = F.array_sort(F.transform(F.concat("__base", "__random"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def cut(piece, first, spans):
        def step(s, x):
            between = F.substr(piece, s["at"] - first + 1, F.greatest(F.lit(0), x["start"] - s["at"]))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], between, F.when(x["start"] >= s["at"], F.lit(mark)).otherwise(F.lit(""))).alias("out"))

        return F.aggregate(spans, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

    def joined(blocks):
        ends = F.transform(blocks, lambda x: F.array_max(F.transform(x, lambda s: s["end"])))
        before = F.aggregate(ends, F.array(F.lit(0)), lambda s, e: F.concat(s, F.array(F.greatest(F.element_at(s, -1), e))))
        return _let(before, lambda b: F.concat(
            F.array_join(F.transform(blocks, lambda x, i: _let(F.struct(F.substr(text, b[i] + 1, b[i + 1] - b[i]).alias("piece"), b[i].alias("first")), lambda y: cut(y["piece"], y["first"], x))), ""),
            F.substr(text, F.element_at(b, -1) + 1, F.length(text)),
        ))

    clean = _let(ordered, lambda x: _let(_blocks(x), joined))
    found = F.size("__base") + F.size("__random") > 0
    return rows.withColumn("text", F.when(found, clean).otherwise(text)).withColumn("__found", found).drop("__base", "__random")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))
