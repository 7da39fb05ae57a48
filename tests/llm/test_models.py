"""op8 and op10: held-out figures, and defined results on odd rows."""

import numpy as np
import zlib

from pyspark.sql import functions as F

from pagemill.llm import langid, quality

from .conftest import SF

SF01 = "/root/testdata/sf0.01"


def test_tables_give_the_network():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(0, 256, (200, 40)).astype(np.uint8), rng.integers(0, 3, 200)
    net = langid.train(windows, labels, 3, epochs=1)
    logits = langid.forward(net, windows)[0]
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(langid.log_probabilities(langid.tables(net), windows), want, atol=1e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 5, b"b" * 16, b"c" * 33]
    offsets = np.cumsum([0, *map(len, texts)])
    windows, which, lengths = langid.cut_windows(np.frombuffer(b"".join(texts), np.uint8), offsets, 16)
    assert which.tolist() == [1, 2, 3, 3, 3] and lengths.tolist() == [5, 16, 16, 16, 1]
    assert all(bytes(w[:n]) == texts[t][:1] * n and not w[n:].any() for w, t, n in zip(windows, which, lengths, strict=True))


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    found = langid.identify(docs, ~langid.held_out("doc_id")).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(found) == docs.count() and held
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_hostile(hostile, empty):
    found = langid.identify(hostile, ~langid.held_out("doc_id"))
    got = found.collect()
    assert len(got) == hostile.count() and "score" in found.columns
    for r in got:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert r.lang_pred == "und" and r.score == 0 or 0 < r.score <= 1
    assert langid.identify(empty, ~langid.held_out("doc_id")).collect() == []
    nothing = langid.identify(hostile, hostile.doc_id == -5).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    one = langid.identify(hostile, hostile.lang == "en").collect()
    assert {r.lang_pred for r in one} == {"und", "en"}


def coded(k):
    """Words of two letters that only language ``k`` has."""
    a, b = chr(97 + k % 26), chr(97 + k // 26)
    return [f"{a}{b}{b}{a} " * (8 + n) for n in range(4)]


def test_more_than_256_languages(spark, monkeypatch):
    rows = [(0, "the common one of all " * n, "aaa") for n in range(1, 30)] + [(k, t, f"x{k:03}") for k in range(300) for t in coded(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen, train = [], langid.train
    monkeypatch.setattr(langid, "train", lambda windows, labels, classes: seen.append((labels, classes)) or train(windows, labels, classes, 1))
    found = langid.identify(docs, F.lit(True)).collect()
    (labels, classes), = seen
    assert classes == 301 and np.bincount(labels).tolist() == [26] + [4] * 300
    assert len(found) == len(rows)


def test_languages_of_copies(spark, monkeypatch):
    """A language of a few texts, copied often, gets all of them; so does every one if there are more than windows."""
    copies = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', id % 20, ' of copies') AS text", "'cc' AS lang")
    others = spark.range(400).selectExpr("id AS doc_id", "concat('other ', id, ' words') AS text", "'oo' AS lang")
    monkeypatch.setattr(langid, "train", lambda windows, labels, classes: np.bincount(labels, minlength=classes).tolist())
    for sample, want in ((50, [20, 25]), (1, [1, 1])):
        assert langid.learn(copies.unionByName(others), F.lit(True), "text", "lang", sample, 256) == (["cc", "oo"], want)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    found = quality.score(docs.select("doc_id", "text"), labels).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in marks]
    good, bad = ([r.score for r in held if marks[r.doc_id] == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_quality_sums_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = ({r.doc_id: r.score for r in quality.score(d.select("doc_id", "text"), labels).collect()} for d in (docs, docs.repartition(5)))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_quality_hostile(spark, hostile, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (7, 0), (8, None), (None, 1), (12, 0)], "doc_id long, quality int")
    for marks in (labels, labels.where("quality = 1"), labels.where("doc_id = 2")):
        got = quality.score(hostile, marks).collect()
        assert len(got) == hostile.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(hostile, labels.where("false")).collect()} == {0.5}
    assert quality.score(empty, labels).collect() == []


def test_monotone():
    at, rates = quality.monotone(np.arange(6.0), np.array([0.0, 0.4, 0.2, 0.3, 1.0, 0.9]), np.ones(6))
    assert np.allclose(rates, [0, 0.3, 0.95]) and np.allclose(at, [0, 2, 4.5])
