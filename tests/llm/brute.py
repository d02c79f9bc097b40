"""The contracts of the queries, restated plainly on lists of (doc_id, text): what the operators are held against."""

import hashlib
import re
from collections import Counter

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, window=10):
    patterns = {}
    for item, text in items:
        words = ITEM.findall(lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            patterns.setdefault(tuple(words[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found = ITEM.findall(lower(text)), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(words) - m + 1):
                if (own := patterns.get(tuple(words[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def licenses(docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = []
    for doc, text in docs:
        words = ITEM.findall(lower(text))
        at = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
        out.append((doc, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    return out


def license_method(text, templates, k=5, slack=3, least=0.8):
    """(labels, score) of the method alone: every chain of hits, straight from the rule."""
    words, best = ITEM.findall(lower(text)), {}
    for label, template in templates:
        own = ITEM.findall(lower(template))
        if len(own) < k:
            continue
        hits = sorted((t, p) for p in range(len(words) - k + 1) for t in range(len(own) - k + 1) if words[p : p + k] == own[t : t + k])
        value = {}
        for t, p in hits:
            value[t, p] = max([k] + [v + min(k, t - u) for (u, q), v in value.items() if u < t and q < p and abs((p - t) - (q - u)) <= slack])
        cover = max(value.values(), default=0) / len(own)
        if cover >= least:
            best[label] = max(best.get(label, 0), cover)
    return set(best), max(best.values(), default=0.0)


def quality(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        words = BLANK.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if BLANK.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        n = len(words)
        out.append((doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n))
    return out


def groups(docs, n=2, percent=80):
    """(set size, number of the group) of every row; every row is a node of its own."""
    sets = []
    for _, text in docs:
        w = BLANK.findall(lower(text))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    return [(len(x), root(i)) for i, x in enumerate(sets)]


def near(docs, n=2, percent=80):
    """Rows (doc_id, n_shingles, component_id, kept)."""
    found, least = groups(docs, n, percent), {}
    for (doc, _), (_, g) in zip(docs, found, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return [(doc, size, least.get(g), doc == least.get(g)) for (doc, _), (size, g) in zip(docs, found, strict=True)]


def repeats(docs, window=35):
    words = [BLANK.findall(text or "") for _, text in docs]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def secrets(docs):
    forms = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    out = []
    for doc, text in docs:
        spans = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(forms) for m in p.finditer(text or "") if ok(m)]
        n = Counter(x[3] for x in spans)
        out.append((doc, n["assign"], n["access"], n["hex"], sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)))))
    return out
