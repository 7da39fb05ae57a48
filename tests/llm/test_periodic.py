"""op11: the grammar's extensions, and runs, against comparisons of all words with all others."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pagemill.llm import periodic
from pagemill.llm.queries import QUERIES

from .conftest import SF, WORD, same


def brute_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_digest(key, text, hurt=True):
    w = WORD.findall(text or "")
    h = zlib.crc32(b"" if key is None else str(key).encode())
    g, n = h // 10, len(w)
    if hurt and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def sequences():
    pick = random.Random(11)
    yield from ([], [1], [1] * 23, [1] * 24, [1] * 500, [1, 2] * 100, list(range(300)))
    for k in range(120):
        letters = pick.choice([1, 2, 3, 30])
        words = [pick.randrange(letters) for _ in range(pick.choice([5, 40, 200, 700]))]
        for _ in range(pick.randrange(4)):
            at, q = pick.randrange(len(words)), pick.choice([1, 2, 7, 8, 9, 30])
            for i in range(at + q, min(len(words), at + q * pick.choice([3, 4, 10]) + pick.randrange(q + 1))):
                words[i] = words[i - q]
        yield words
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield ([0] * 50 + [1]) * 20
    yield [x for k in range(40) for x in [0] * k + [1]]


def test_extensions():
    pick = np.random.default_rng(1)
    for letters, n in ((1, 200), (2, 3000), (4, 900), (1000, 700)):
        words = pick.integers(0, letters, n)
        words[n // 2:] = words[: n - n // 2]
        words = np.concatenate([[letters + 1], words, [letters]])
        levels = periodic.recompress(words)
        assert len(levels[-1].symbols) <= periodic.FEW
        mirror = [level.mirrored(len(words)) for level in levels]
        i, j = pick.integers(1, n + 1, 400), pick.integers(1, n + 1, 400)
        i, j = i[i != j], j[i != j]
        right = [next(k for k in range(n + 2) if words[x + k] != words[y + k]) for x, y in zip(i, j, strict=True) for x, y in [(x, y)] if True]
        left = [next(k for k in range(n + 2) if words[x - k] != words[y - k]) for x, y in zip(i, j, strict=True)]
        assert periodic.extend(levels, i, j).tolist() == right
        assert periodic.extend(mirror, len(words) - 1 - i, len(words) - 1 - j).tolist() == left


def test_runs():
    made = list(sequences())
    want = [brute_runs(w) for w in made]
    assert sum(map(len, want)) > 100
    arrays = [np.array(w, np.int64) for w in made]
    assert [list(map(tuple, r.tolist())) for r in periodic.runs_of(arrays)] == want
    assert [list(map(tuple, periodic.runs_of([a])[0].tolist())) for a in arrays] == want
    for least, times in ((2, 2), (10, 2), (4, 4)):
        assert [list(map(tuple, r.tolist())) for r in periodic.runs_of(arrays[:60], least, times)] == [brute_runs(w, least, times) for w in made[:60]]


def test_few_candidates_and_words_at_once(monkeypatch):
    monkeypatch.setattr(periodic, "CANDIDATES_AT_ONCE", 3)
    made = list(sequences())[:70]
    assert [list(map(tuple, r.tolist())) for r in periodic.runs_of([np.array(w, np.int64) for w in made])] == [brute_runs(w) for w in made]


def test_hostile(spark, hostile, rows, empty, monkeypatch):
    more = [(20, "ab " * 30), (21, " ".join(f"a{i % 9} b" for i in range(40)) + "\ttail"), (22, "x " * 23), (23, "é　y " * 25 + "z " * 40)]
    for df, pairs in ((hostile, [(r[0], r[1]) for r in rows]), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        got = periodic.find_runs(df.withColumn("runs", periodic.F.lit("mine")))
        want = []
        for key, text in pairs:
            if text is not None and len(text) > 100_000:
                text_runs = []  # x{i % 977}y{i}: no two words are equal
            else:
                text_runs = brute_runs(WORD.findall(text or ""))
            want.append((key, text_runs))
        same([(r.doc_id, [tuple(x) for x in r.runs]) for r in got.collect()], want)
    assert periodic.find_runs(empty).collect() == []


@pytest.mark.parametrize("least", [200_000, 300])
def test_query(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", least)
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [(k, t) for k, t in pairs if t is None or len(t) < 8000] + [(None, "a b " * 30), (None, None), (5, "")]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [brute_digest(*p) for p in short]
    assert sum(w[1] > 0 for w in want) >= 10
    same([tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()], want)
    assert re.fullmatch("[0-9a-f]{64}", want[0][-1])
