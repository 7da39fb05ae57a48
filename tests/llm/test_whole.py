"""The pipeline against a brute-force version, the oracles, and the registry."""

import duckdb
import pytest

import corpus_pipeline
from pagemill.llm.queries import ORACLE, QUERIES

from .conftest import SF, brute_benchmark, brute_components, brute_mix, brute_print, brute_repeats, same


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r for r in docs if r.text and any(c.isalpha() for c in r.text)]
    tops = brute_components([brute_print(r.text) for r in docs])
    first = {}
    for r, t in zip(docs, tops, strict=True):
        first[t] = min(first.get(t, r), r, key=lambda r: r.doc_id)
    kept = sorted(first.values(), key=lambda r: r.doc_id)
    cut = {key: text for key, _, _, text in brute_repeats([(r.doc_id, r.text) for r in kept], 35)}
    clean = [w[0] for w in brute_benchmark(list(cut.items()), items) if not w[2]]
    source = {r.doc_id: r.source for r in kept}
    mix = brute_mix([(i, source[i], len(cut[i].split())) for i in clean])
    want = [(i, cut[i], len(cut[i]), n) for i, (_, times) in zip(clean, mix, strict=True) for n in range(1, times + 1)]
    found = corpus_pipeline.run(spark, SF)
    same([(r.doc_id, r.text, r.n_chars, r.repetition) for r in found.collect()], want)
    assert len(clean) > 100


def test_stages_keep_the_columns(spark, hostile):
    docs = hostile.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.checkpoint()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name]).to_arrow_table()
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(want.column_names)
    order = sorted(found.columns)
    same([[r[c] for c in order] for r in found.collect()], [[r[c] for c in order] for r in want.to_pylist()])


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
