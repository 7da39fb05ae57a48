"""op2 against brute force; op7 against brute force."""

import pathlib

import numpy as np

from pagemill.llm import common, decontaminate, neighbours
from pyspark.sql import functions as F

from .conftest import SF, brute_benchmark, same


def brute_nearest(rows, k=10):
    out = {}
    seen = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q, v in sorted(seen):
        if q % 100 == 0:
            far = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in seen if i != q and len(w) == len(v))
            out[q] = far[:k]
    return out


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    want = brute_nearest([(r.vec_id, [float(x) for x in r.embedding]) for r in rows.collect()])
    hits = 0
    found = neighbours.nearest_neighbours(rows, F.col("vec_id") % 100 == 0, block=128, chunk=2).collect()
    for r in found:
        near = dict((i, s) for s, i in want[r.query_id])
        hits += r.vec_id in near
        assert r.vec_id not in near or abs(near[r.vec_id] - r.score) < 1e-12
    assert len(found) == 10 * len(want)
    assert hits >= 0.9 * len(found)


def test_hostile_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-4.0, 2.5]), (100, [1.0, 0.5]), (200, [3.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    found = neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == brute_nearest(rows)
    assert got[0][0] == (0.0, 1) and got[0][1] == (0.0, 2)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect() == []


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "No ID, but WORDS!"), (3, None), (4, "..."), (5, "one"), (None, "Straße über größe"),
         (10, " ".join(f"w{i}" for i in range(14))), (1, " ".join(f"w{i}" for i in range(14))), (6, "a b " * 9)]


def found_in(docs, items, **options):
    found = decontaminate.find_benchmark(docs, items, **options)
    return [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()]


def test_benchmark_hostile(spark, hostile, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_benchmark([(r[0], r[1]) for r in rows], ITEMS)
    same(found_in(hostile, items), want)
    same(found_in(hostile, items, round_bytes=20), want)  # one item a round


def test_benchmark_real(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_benchmark([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    same(found_in(docs, items), want)
    assert any(w[2] for w in want)


def test_benchmark_empty(spark, hostile, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found_in(empty, items) == []
    assert all(not r[2] and not r[3] for r in found_in(hostile, items.where("false")))


def test_rounds_follow_each_other(spark, hostile, rows):
    """One round's search in the plan of the result, one table in the shared folder, the same rows as in one round."""
    text = next(r[1] for r in rows if r[0] == 1).split()
    items = spark.createDataFrame([(i, " ".join(text[i : i + 12])) for i in range(0, 48, 6)], "item_id long, text string")
    folder = pathlib.Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("llm-*"))
    found = decontaminate.find_benchmark(hostile, items, round_bytes=60)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert len(set(folder.glob("llm-*")) - before) == 1
    same(found.collect(), decontaminate.find_benchmark(hostile, items).collect())
    assert found.where("contaminated").count() >= 4
