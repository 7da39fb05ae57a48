import hashlib
import re
from collections import Counter

import pytest
import xxhash

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, score string"


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names clash."""
    passage = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i % 977}y{i}" for i in range(30_000))
    made = [
        (1, passage, "en", "a"), (2, "Start here " + passage + " and end", "en", "a"), (3, passage.upper(), "de", "b"),
        (3, passage.upper(), "de", "b"), (4, None, None, None), (5, "", "fr", ""), (6, " \t\n ", "fr", "é"), (7, long, "en", "a"),
        (None, "no id but words", "en", None), (None, "no id but words", "en", None), (None, None, None, "b"),
        (8, "a b " * 40, "es", "\U0001F600"), (9, "one", "es", "￿"), (10, "no break   1234 !!! ###", None, "b"),
        (11, "one", "es", "a"), (12, "größe Straße über " * 5, "de", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 5, "mine", None) for r in made]


@pytest.fixture(scope="session")
def hostile(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, wanted):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, map(tuple, wanted)))


def brute_repeats(pairs, window):
    """(id, text) → (id, words, removed, kept text)."""
    texts = [WORD.findall(t or "") for _, t in pairs]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(pairs, texts, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((key, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_print(text):
    w = WORD.findall(ascii_lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    """Index of the component of each fingerprint."""
    name = list(range(len(prints)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                p, q = top(i), top(j)
                name[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(prints))]


def brute_benchmark(pairs, items, size=10):
    """(id, text) and (item, text) → (id, words, hit, item ids)."""
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for item, text in items:
        w = word.findall(ascii_lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for key, text in pairs:
        w = word.findall(ascii_lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def brute_mix(triples, share=1.5, epochs=2.0, weights=(3, 1, 2)):
    """(id, source, size) in input order → (target of the source, repeats) for each."""
    sizes = Counter()
    for _, source, size in triples:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target = share * sum(sizes.values()), {}
    while len(target) < len(order):
        left = [s for s in order if s not in target]
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        capped = [s for s in left if weight[s] * level >= epochs * sizes[s]]
        target |= {s: epochs * sizes[s] for s in capped} if capped else {s: weight[s] * level for s in left}
    repeats = [0] * len(triples)
    for s in order:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        of = [i for i, t in enumerate(triples) if t[1] == s]
        key = lambda i: (hashlib.md5(f"mix-1|{'' if triples[i][0] is None else triples[i][0]}".encode()).hexdigest(), triples[i][2])
        for i in sorted(of, key=key):
            repeats[i] = whole + (rest > 0 and before + triples[i][2] / 2 <= rest)
            before += triples[i][2]
    return [(target[t[1]], r) for t, r in zip(triples, repeats, strict=True)]
