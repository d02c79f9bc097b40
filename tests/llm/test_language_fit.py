"""What language identification learns: all learning rows, by brute force, and not a sample of them."""

import itertools
import math
import random
import zlib

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from helpers import SF

from siftyard.llm import langid


@pytest.fixture(scope="module")
def learning(spark):
    """The learning rows of the smallest table, and (language, text) of each, in lower case and UTF-8."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    known = [r for r in table if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    rows = spark.createDataFrame([(r["lang"], r["text"]) for r in known], "lang string, text string")
    return docs, rows, [(r["lang"], r["text"].lower().encode()) for r in known]


def bucket(run: bytes) -> int:
    x, mask = int.from_bytes(run, "big"), (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return (x ^ (x >> 31)) >> 46


def runs(data: bytes) -> set[int]:
    return {bucket(x) for x in {data[i : i + 6] for i in range(len(data) - 5)}}


def elected_by(rows, weights):
    """The candidates of each language and half."""
    out = {}
    for lang, half, part in langid.candidates(rows, rows.sparkSession.sparkContext.broadcast(weights)).collect():
        out.setdefault((lang, half), []).append(bytes(part))
    return out


def test_every_row_is_counted_and_every_stretch_elected(learning):
    _, rows, known = learning
    weights, best = {}, {}
    for lang, data in known:
        for b in runs(data):
            weights[lang, b] = weights.get((lang, b), 0) + 1
    found = langid.frequencies(rows)
    assert {(lang, b): int(n) for lang, own in found.items() for b, n in enumerate(own.tolist()) if n} == weights
    for lang, data in known:
        for i in range(0, len(data), 240):
            part = data[i : i + 240]
            own = runs(part)
            for slot in (("least", min(own, default=None)), ("greatest", max(own, default=None))):
                key = (lang, zlib.crc32(data) % 2, slot)
                best[key] = max(best.get(key, (-1, b"")), (sum(weights[lang, b] for b in own), part))
    told = elected_by(rows, found)
    elected = {}
    for (lang, half, _), (_, part) in best.items():
        elected.setdefault((lang, half), set()).add(part)
    assert {k: sorted(v) for k, v in told.items()} == {k: sorted(v) for k, v in elected.items()}


def test_texts_in_segments(learning, spark):
    """Texts longer than what is scored at once, and more languages than a worker holds tables of."""
    _, rows, known = learning
    long = b" ".join(data for _, data in known)[:200_000].decode(errors="ignore")
    many = spark.createDataFrame([(f"x{i % 70}", f"text {i} of many languages") for i in range(280)] + [("long", long)], "lang string, text string").coalesce(1)
    found = langid.frequencies(many)
    assert len(found) == 71 and all(own[bucket(b"many l")] == 4 for lang, own in found.items() if lang != "long")
    data, own = (long * 6).encode(), langid.frequencies(spark.createDataFrame([("long", long * 6)], "lang string, text string"))["long"]
    assert len(data) > langid.SCORED * langid.STRETCH and {b for b, n in enumerate(own.tolist()) if n} == runs(data) and own.max() == 1
    for part, least, greatest, score in itertools.islice(langid.scored(data, own), 4090, 4100):
        assert (least, greatest, score) == (min(runs(part)), max(runs(part)), len(runs(part)))
    assert b"".join(x for x, *_ in langid.scored(data, own)) == data


def test_least_margins_are_of_every_piece(learning):
    """Every different piece of every learning row, by dictionaries of the other half."""
    docs, rows, known = learning
    weights = langid.frequencies(rows)
    told = elected_by(rows, weights)
    halves = [langid.Languages([(lang, langid.content_of(told.get((lang, h), []), weights[lang])) for lang in weights]) for h in (0, 1)]
    pieces = set()
    for lang, data in known:
        at = 0
        for n in (4096, 2048, 1024, 512, 256, 128, 64):
            while len(data) - at >= n:
                pieces.add((lang, n, zlib.crc32(data) % 2, data[at : at + n]))
                at += n
        assert len(data) - at < 64
    margins: dict = {}
    for lang, n, half, piece in pieces:
        names = halves[1 - half].names
        if lang not in names or len(names) < 3 or not any(c.isalpha() for c in piece.decode(errors="ignore")):
            continue
        (sizes,) = halves[1 - half].sizes([piece])
        ordered = sorted(sizes)
        margin = (ordered[1] - ordered[0]) / ordered[1]
        if names[sizes.index(ordered[0])] == lang and margin >= 0.001:
            margins.setdefault((n, "right"), {}).setdefault((piece, lang, margin), lang)
        rest = sorted(x for x, name in zip(sizes, names, strict=True) if name != lang)
        margins.setdefault((n, "other"), {}).setdefault((piece, lang, margin, rest[0], rest[1]), lang)
    expected = []
    for n in (64, 128, 256, 512, 1024, 2048, 4096):
        bounds = []
        for kind, share in (("right", 0.003), ("other", 0.99)):
            own = margins.get((n, kind), {})
            value = lambda k, kind=kind: int((k[2] if kind == "right" else (k[4] - k[3]) / k[4]) * 10_000)
            langs = list(own.values())
            steps = sorted((value(k), 1 / max(100, langs.count(lang))) for k, lang in own.items())
            total, below = sum(x for _, x in steps), 0.0
            for step, x in steps:
                below += x
                if below > share * total + 1e-9:
                    bounds.append(step)
                    break
        if len(bounds) == 2:
            expected.append((n, min(bounds) / 10_000))
    got = langid.fit(docs).margins
    assert len(got) == len(expected) and all(n == m and math.isclose(x, y) for (n, x), (m, y) in zip(got, expected, strict=True))


def made(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9))) for _ in range(n))


def test_wording_of_a_few_rows_in_many_is_learnt(spark):
    """Each of 100 phrases of a language stands in 20 of its 2,000 rows: the dictionary has them all (a sample of 160 rows has
    not), and the pipeline's first stage keeps texts of them."""
    rnd, docs, phrases = random.Random(3), [], {}
    for lang in ("aa", "bb", "cc"):
        phrases[lang] = [made(rnd, 8) for _ in range(100)]
        docs += [(f"{phrases[lang][k % 100]} {made(rnd, 12)}", lang) for k in range(2000)]
    rows = [(i, text, lang, "web", len(text)) for i, (text, lang) in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    source = spark.createDataFrame(rows, schema)
    model = dict(langid.fit(source))
    missing = {lang: sum(x.encode() not in model[lang] for x in own) for lang, own in phrases.items()}
    assert not any(missing.values()), missing
    asked = [(10**6 + i, f"{a} {b}", None, "web", None) for i, (a, b) in enumerate(pair for own in phrases.values() for pair in itertools.pairwise(own))]
    kept = corpus_pipeline.language(spark, source.unionByName(spark.createDataFrame(asked, schema)), SF)
    assert kept.filter("doc_id >= 1000000").count() == len(asked)


def test_near_copies_do_not_fill_a_dictionary(spark):
    """Near copies of one text, each shifted by a few bytes, are a third of the rows: other wording is learnt all the same."""
    rnd = random.Random(9)
    base, common = made(rnd, 400), [made(rnd, 8) for _ in range(30)]
    copies = [(f"{'x' * (k % 240 + 1)} {base} {k}", "aa") for k in range(500)]
    plain = [(f"{common[k % 30]} {made(rnd, 20)}", "aa") for k in range(1000)]
    source = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(copies + plain)], "doc_id long, text string, lang string")
    ((_, content),) = langid.fit(source)
    assert all(x.encode() in content for x in common)


def test_blocks_met_before_are_not_compressed_again(monkeypatch):
    """Copies and common openings cost one compression by each dictionary, and sizes stay what they are one by one."""
    rnd = random.Random(4)
    model = [(lang, made(rnd, 300).encode()) for lang in ("aa", "bb", "cc")]
    opening, texts = made(rnd, 1200).encode()[:4096], [made(rnd, n).encode() for n in (1, 20, 2000)]
    texts = [*texts, opening + texts[0], opening + texts[1], *texts, opening, texts[2][:4096]] * 2
    expected = [next(langid.Languages(model).sizes([x])) for x in texts]
    for most in (langid.KNOWN, 4):
        monkeypatch.setattr(langid, "KNOWN", most)
        languages, asked = langid.Languages(model), []
        languages.compress = [lambda x, f=f: (asked.append(x), f(x))[1] for f in languages.compress]
        assert [*languages.sizes(texts[:9]), *languages.sizes(texts[9:])] == expected
        if most > 4:
            assert len(asked) == 3 * len({x[i : i + 4096] for x in texts for i in range(0, len(x), 4096)})


def test_fit_reads_every_row_three_times(learning, spark):
    """Counts (of runs and of rows), stretches, margins."""
    docs, *_ = learning
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    model = langid.fit(docs.mapInArrow(told, docs.schema))
    assert read.value == 3 * docs.count()
    assert list(model) == list(langid.fit(docs)) and model.margins == langid.fit(docs).margins


def test_stretches_of_a_dictionary_by_brute_force():
    """Always the stretch whose runs not yet there stand in most rows, the smallest of equals."""
    rnd = random.Random(5)
    for letters, n in (("ab", 700), ("abcdefgh", 900), ("ab", 3)):
        parts = list({"".join(rnd.choice(letters) for _ in range(rnd.choice((3, 6, 40, 240)))).encode() for _ in range(n)})
        weights = langid.np.zeros(langid.BUCKETS + 1, langid.np.int64)
        for b in set().union(*map(runs, parts)):
            weights[b] = rnd.randint(1, 3)
        left, rest, expected = weights.copy(), {x: sorted(runs(x)) for x in parts}, []
        while rest and len(expected) < langid.PARTS:
            x = min(rest, key=lambda x: (-left[rest[x]].sum(), x))
            expected.append(x)
            left[rest.pop(x)] = 0
        assert langid.content_of(parts, weights) == b"\n".join(reversed(expected))
