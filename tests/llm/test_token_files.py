"""op12: exact round trips against the library's ids of whole texts."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest

from pagemill.llm import token_files, tokens
from pagemill.llm.queries import QUERIES

from .conftest import SF, same

PATH = public_tokenizers.path("word_bpe_49k.json")


def wanted(pairs, end=2):
    """Null ids first, then ascending; ties by the hash that Spark gives are left to the caller."""
    library, at, out = tokens.load(PATH), 0, []
    for key, text in pairs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, *([] if end is None else [end])], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def found(df):
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in df.collect()]


def test_hostile_texts(spark, tmp_path, hostile, rows):
    odd = [(-1, "It's we'll DON'T <|endoftext|> x<|startoftext|>y"), (-2, "a\x1cb\x85c　d\x0be\x0cf g"), (-3, "ΑΣ Σ é é ́x İ ŉ"),
           (-4, "日本 123 ½ ‘q’ \U0001F600"), (-5, "z" * 5000), (-6, "' s 'S I 'LL it' s"), (-7, " "), (-8, "A <|ENDOFTEXT|> B"), (-9, "ÀB <|endoftext|>C\tDE"), (1 << 40, "\x00 ​﻿")]
    pairs = [(r[0], r[1]) for r in rows if r[0] is not None] + odd
    df = spark.createDataFrame(pairs + [(None, None)] * 3, "doc_id long, text string").withColumn("ids", token_files.F.lit("mine"))
    token_files.write(df, f"{tmp_path}/a", PATH, 2)
    # the two rows of id 3 are equal; the three null ids too
    same(found(token_files.read(spark, f"file://{tmp_path}/a")), wanted([(None, None)] * 3 + sorted(pairs, key=lambda p: p[0])))
    index = json.loads((tmp_path / "a" / "_index.json").read_text())
    assert index["dtype"] == "<u2" and sum(p["nulls"] for p in index["parts"]) == 3
    ids = np.concatenate([np.fromfile(tmp_path / "a" / f"{p['name']}.ids", "<u2") for p in index["parts"]])
    assert len(ids) == index["ids"] and [p["base"] for p in index["parts"]] == [0, *np.cumsum([p["ids"] for p in index["parts"]])[:-1]]
    with pytest.raises(Exception, match="already holds"):
        token_files.write(df, f"{tmp_path}/a", PATH, 2)


def test_small_caches_slices_and_batches(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_files, "CACHED_BYTES", 5)
    encoder = token_files.Encoder(PATH, "<u4")
    made = [encoder.text(t.encode()) for _, t in pairs[:40]]
    assert [(len(m) // 4, zlib.crc32(m)) for m in made] == [w[2:] for w in wanted(pairs[:40], None)]
    token_files.write(docs, f"{tmp_path}/b", PATH, 2)
    monkeypatch.setattr(token_files, "SLICE_IDS", 1000)
    monkeypatch.setattr(token_files, "SEND_BYTES", 400)
    reader = token_files.Reader(f"{tmp_path}/b")
    slices = reader.partitions()
    assert len(slices) > 50
    got = [r for s in slices for b in reader.read(s) for r in b.to_pylist()]
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got] == wanted(pairs)


def test_words_of_many_characters():
    """Letters of Latin-1 and punctuation in all places, against the library."""
    import random

    pick, encoder = random.Random(5), token_files.Encoder(PATH, "<u2")
    signs = [chr(c) for c in range(33, 127)] + [chr(c) for c in range(0xA1, 0x180)] + ["ß", "Σ", "ı", "́", "日", "'s", "<|endoftext|>"]
    words = [*signs, *("x" + c for c in signs), *(c + "'" for c in signs)]
    words += ["".join(pick.choice(signs) for _ in range(pick.randrange(1, 7))) for _ in range(6000)]
    words += ["".join(pick.choice("abcDEFéÀü") for _ in range(pick.randrange(1, 12))) + pick.choice([".", ",", "$$$", "?!", ";", "'", "...", ""]) for _ in range(6000)]
    for w in words:
        assert np.frombuffer(encoder.text(w.encode()), "<u2").tolist() == encoder.tokenizer.encode(w, add_special_tokens=False).ids, w
    assert encoder.words is not None and len(encoder.words.cores) > 1000


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = token_files.Encoder(path, "<u2"), tokens.load(path)
    for text in ("two  spaces\n\n and\ttabs ", "", "é à <|endoftext|> x"):
        assert np.frombuffer(encoder.text(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.words is None


def test_one_id_fills_many_parts(spark, tmp_path):
    df = spark.range(0, 3000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 7 END AS doc_id", "concat('word', id % 2) AS text")
    token_files.write(df, f"{tmp_path}/c", PATH, None)
    rows = token_files.read(spark, f"{tmp_path}/c").collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([7] * 2000 + list(range(0, 3000, 3)))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert len(json.loads((tmp_path / "c" / "_index.json").read_text())["parts"]) > 2
    assert max(p["docs"] for p in json.loads((tmp_path / "c" / "_index.json").read_text())["parts"]) < 2000


def test_empty_and_query(spark, tmp_path, empty):
    token_files.write(empty, f"{tmp_path}/d", PATH, 2)
    assert token_files.read(spark, f"{tmp_path}/d").collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    same([tuple(r) for r in QUERIES["op12_token_files"](spark, SF).collect()], wanted(sorted(map(tuple, docs))))
