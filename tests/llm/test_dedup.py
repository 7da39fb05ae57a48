"""op1 and op3: repeated windows and near-duplicates against brute force."""

import numpy as np
import pytest

from pagemill.llm import simhash, substring
from pagemill.llm.components import connected_components

from .conftest import SF, brute_components, brute_print, brute_repeats, same


@pytest.mark.parametrize("window", [35, 8, 1])
def test_repeats_hostile(hostile, rows, window):
    found = substring.remove_repeats(hostile, window=window)
    assert found.columns == [*hostile.columns, "n_words", "n_removed"]
    same([(r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect()], brute_repeats([(r[0], r[1]) for r in rows], window))


def test_repeats_three_levels():
    assert substring.levels(35) == [18, 35]
    assert substring.levels(100) == [25, 50, 100]


def test_repeats_long_window(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), "x " + " ".join(words[10:150]) + " y", " ".join(words[200:280]), " ".join(words[:90] + words[100:220])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring.remove_repeats(df, window=100)
    same([(r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect()], brute_repeats(list(enumerate(texts)), 100))


def test_repeats_real(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = substring.remove_repeats(docs).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.text) for r in found], brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 35))


def test_repeats_read_one_shuffle_of_the_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = substring.remove_repeats(docs)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(empty):
    assert substring.remove_repeats(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.deduplicate(empty).collect() == []


def test_golay_indices_meet():
    check, table = simhash.golay()
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 23, 20_000)
    for flips in (0, 1, 2):
        changed = values.copy()
        for _ in range(flips):
            changed ^= 1 << rng.integers(0, 23, len(values))
        a, b = (simhash.segment_indices(v, check, table) for v in (values, changed))
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()


def test_keys_meet_at_four_bits():
    check, table = simhash.golay()
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    changed = prints.copy()
    for i in range(len(changed)):
        for bit in rng.permutation(64)[: i % 5]:
            changed[i] ^= np.uint64(1 << int(bit))
    (k1, r1), (k2, r2) = (simhash.keys_of(p, check, table) for p in (prints, changed))
    assert all(set(k1[r1 == i]) & set(k2[r2 == i]) for i in range(len(prints)))


def wanted_classes(pairs):
    prints = [brute_print(t) for _, t in pairs]
    tops = brute_components(prints)
    least: dict = {}
    for (key, _), t in zip(pairs, tops, strict=True):
        if key is not None:
            least[t] = min(key, least.get(t, key))
    return [(k, f"{p:016x}", least.get(t)) for (k, _), p, t in zip(pairs, prints, tops, strict=True)]


def test_near_duplicates_hostile(hostile, rows):
    same(simhash.near_duplicates(hostile).collect(), wanted_classes([(r[0], r[1]) for r in rows]))


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 2])
def test_near_duplicates_real(spark, chunk):
    """Chunks of two fingerprints take every larger bucket through the chunk-by-chunk way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    more = spark.createDataFrame([(100_000 + i, " ".join(words * 30 + [words[i % 10], str(i)])) for i in range(40)], docs.schema)
    docs = docs.unionByName(more)
    same(simhash.near_duplicates(docs, chunk=chunk).collect(), wanted_classes([(r.doc_id, r.text) for r in docs.collect()]))


def test_deduplicate_keeps_one_row_of_each_class(hostile, rows):
    kept = simhash.deduplicate(hostile)
    assert kept.columns == hostile.columns
    tops = brute_components([brute_print(r[1]) for r in rows])
    want = {t: min((r[0] is None, r[0] or 0) for r, u in zip(rows, tops, strict=True) if u == t) for t in set(tops)}
    same([((r.doc_id is None, r.doc_id or 0),) for r in kept.collect()], [(v,) for v in want.values()])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
