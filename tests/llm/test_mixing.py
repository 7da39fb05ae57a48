"""op6: targets by repeated capping, and repetitions in hash order."""

from pagemill.llm import mixing
from pyspark.sql import functions as F

from .conftest import SF, WORD, brute_mix


def check(df):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = [len(WORD.findall(r.text or "")) for r in rows]
    want = brute_mix([(r.doc_id, r.source, n) for r, n in zip(rows, sizes, strict=True)])
    found = mixing.decide(df).select("doc_id", "source", F.col("size").alias("n"), "target", "repeats").collect()
    order = lambda x: (str(x[0]), str(x[1]), x[2], x[4])
    wanted = [(r.doc_id, r.source, n, *w) for r, n, w in zip(rows, sizes, want, strict=True)]
    for a, b in zip(sorted(map(tuple, found), key=order), sorted(wanted, key=order), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-6 * max(1, b[3])
    taken = {}
    for r in found:
        words, target, largest = taken.get(r.source, (0, r.target, 0))
        taken[r.source] = (words + r.n * r.repeats, target, max(largest, r.n))
    assert all(abs(words - target) <= largest / 2 + 1e-6 for words, target, largest in taken.values())
    assert all(r.repeats <= 2 for r in found)


def test_hostile(hostile):
    check(hostile)


def test_real(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_rows_are_repeated(hostile):
    found, plan = mixing.mix(hostile), mixing.decide(hostile)
    assert set(found.columns) == {*hostile.columns, "source_size", "repetition"}
    assert found.count() == plan.agg(F.sum("repeats")).first()[0]


def test_reruns_agree(hostile):
    a, b = (sorted(map(repr, mixing.decide(h).collect())) for h in (hostile, hostile.repartition(7)))
    assert a == b


def test_empty(empty):
    assert mixing.decide(empty).collect() == []


def test_no_python_on_the_path(spark):
    plan = mixing.decide(spark.read.parquet(f"{SF}/documents.parquet"))
    assert not any(x in plan._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
