"""Token ids in flat binary files with 64-bit document offsets, as a data source ``token_ids`` of the session.

``encode`` gives every document its ids by the tokenizer library; ``write`` deals the documents into ranges of
ascending id and each task appends its range to three files of its own: the ids as unsigned little-endian integers
(16 bits where the vocabulary allows it, else 32), the offsets of its documents in them (unsigned, 64 bits, one more
than there are documents) and the document ids (signed, 64 bits). On commit the parts' bases, the ids and documents
before each, come from prefix sums of the parts' sizes and go with the file names into ``_index.json``. ``read`` maps
the files into memory (a store that has no mapping is read by ranges) and cuts every part into slices, each a task of its own.

A task that fails or runs twice leaves files that no index names; the index is written once, after all tasks. A
folder is written once: it must not hold an index yet. Files go where ``pyarrow.fs`` and Spark both reach.

A tokenizer that drops white space (its file says so) gets the words one by one; each goes to the library once and then lies
in a bounded cache, so that a long text never makes a long list of the library's objects. A word of plain letters and
punctuation is one or two pre-tokens, which go to the library's model without its normalizer. Other tokenizers get whole texts.

Defined results: a null or empty text has only the end id; null document ids come first; repeated ids follow in the
order of their texts' 64-bit hashes, equal rows in any order (they are dealt out by a running number, so one id may fill many
parts); an empty table gives an index without parts and an empty result; extra columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import lean, prepare
from .tokens import load

#: The words a worker remembers, and the longest of them in bytes.
CACHE_WORDS, CACHED_BYTES = 300_000, 64
#: Ids of one task of a read, and bytes of one batch that it sends.
SLICE_IDS, SEND_BYTES = 16 << 20, 4 << 20

#: The steps of a tokenizer file before its model under which white space is dropped and words are separate.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Words of one or two pre-tokens by those steps: letters of Latin-1, which have one lower case, then punctuation without apostrophes.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

INDEX = "_index.json"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class Words(dict):
    """Packed ids of words: a bounded cache before the library, which starts anew when it is full."""

    def __init__(self, tokenizer, code: str, most: int):
        super().__init__()
        self.tokenizer, self.code, self.most = tokenizer, code, most
        self.model, self.cores = tokenizer.model, {}
        split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): split(c)[0][0] for c in map(chr, range(97, 256)) if SIMPLE.fullmatch(c) and c == c.lower()}

    def core(self, part: str) -> bytes:
        """A single pre-token: the library's model alone."""
        found = self.cores.get(part)
        if found is None:
            found = array(self.code, [t.id for t in self.model.tokenize(part.translate(self.letters))]).tobytes()
            if len(self.cores) >= self.most:
                self.cores.clear()
            self.cores[part] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        simple = SIMPLE.fullmatch(text) if len(word) <= CACHED_BYTES else None
        if simple:
            found = self.core(simple[1].lower()) + (self.core(simple[2]) if simple[2] else b"")
        else:
            found = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Packed ids of texts: by words if the tokenizer drops white space, else whole."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        self.tokenizer, self.code = load(path), {"<u2": "H", "<u4": "I"}[dtype]
        if sys.byteorder != "little":
            raise OSError("token files are written on little-endian machines")
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        whole = (parts["normalizer"], parts["pre_tokenizer"]) != (NORMALIZER, PRE_TOKENIZER) or parts["post_processor"]
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = None if whole else Words(self.tokenizer, self.code, CACHE_WORDS)

    def text(self, text: bytes | None) -> bytes:
        if self.words is None:
            return array(self.code, self.tokenizer.encode((text or b"").decode(), add_special_tokens=False).ids).tobytes()
        text = text or b""
        low = text.lower()  # A-Z alone: fewer words to remember; the tokenizer does it too, but for special strings
        return b"".join(map(self.words.__getitem__, (text if any(s in low for s in self.special) else low).split()))


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None, *, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``ids``: packed little-endian integers as wide as ``id_type`` says."""
    prepare(docs.sparkSession)
    dtype = id_type(load(tokenizer_path).get_vocab_size(with_added_tokens=True))
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    rows = docs.select(*[c for c in docs.columns if c not in (text, "ids")], F.col(text).cast("binary").alias("ids"))

    def run(batches):
        encoder = Encoder(tokenizer_path, dtype)
        for batch in batches:
            ids = [encoder.text(t.as_py()) + end for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=batch.schema.names)

    return rows.mapInArrow(lean(run), rows.schema)


def store(path: str):
    """File system and path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    docs: int
    ids: int
    nulls: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype
        fs, folder = store(path)
        if fs.get_file_info(f"{folder}/{INDEX}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} already holds an index of token ids")
        fs.create_dir(folder, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        fs, folder = store(self.path)
        number, width = TaskContext.get().partitionId(), int(self.dtype[-1])
        part = Part(number, f"part-{number:06d}-{uuid.uuid4().hex}", 0, 0, 0)
        outs = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if outs is None:
                outs = [fs.open_output_stream(f"{folder}/{part.name}.{kind}") for kind in ("ids", "offsets", "docs")]
                outs[1].write(np.zeros(1, "<u8").tobytes())
            values = batch.column("ids").to_pylist()
            ends = part.ids + np.cumsum([len(v) // width for v in values], dtype=np.int64)
            keys = batch.column("doc_id")
            for out, data in zip(outs, (b"".join(values), ends.astype("<u8").tobytes(), keys.fill_null(0).to_numpy().astype("<i8").tobytes()), strict=True):
                out.write(data)
            part.docs, part.ids, part.nulls = part.docs + len(values), int(ends[-1]), part.nulls + keys.null_count
        for out in outs or ():
            out.close()
        return part

    def commit(self, messages):
        """Bases are prefix sums over the parts in order; null document ids come first, so a count says which they are."""
        parts, ids, docs = [], 0, 0
        for p in sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.number):
            parts.append({"name": p.name, "base": ids, "first": docs, "ids": p.ids, "docs": p.docs, "nulls": p.nulls})
            ids, docs = ids + p.ids, docs + p.docs
        fs, folder = store(self.path)
        with fs.open_output_stream(f"{folder}/{INDEX}.new") as out:
            out.write(json.dumps({"dtype": self.dtype, "ids": ids, "docs": docs, "parts": parts}).encode())
        fs.move(f"{folder}/{INDEX}.new", f"{folder}/{INDEX}")

    def abort(self, messages):
        fs, folder = store(self.path)
        for p in messages:
            if p is not None and p.docs:
                for kind in ("ids", "offsets", "docs"):
                    fs.delete_file(f"{folder}/{p.name}.{kind}")


@dataclass
class Slice(InputPartition):
    """Documents ``at`` to ``to`` of a part."""
    name: str
    base: int
    at: int
    to: int
    nulls: int


def mapped(fs, path: str, dtype: str, at: int, n: int) -> np.ndarray:
    """``n`` numbers of a file from number ``at``: mapped into memory, or read where files can't be mapped."""
    width = int(dtype[-1])
    if n == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", at * width, (n,))
    with fs.open_input_file(path) as source:
        return np.frombuffer(source.read_at(n * width, at * width), dtype)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        fs, folder = store(path)
        with fs.open_input_file(f"{folder}/{INDEX}") as source:
            self.index = json.loads(source.read())

    def partitions(self):
        out = []
        for p in self.index["parts"]:
            cuts = max(1, min(p["docs"], -(-p["ids"] // SLICE_IDS)))
            edges = [p["docs"] * i // cuts for i in range(cuts + 1)]
            out += [Slice(p["name"], p["base"], a, b, p["nulls"]) for a, b in zip(edges, edges[1:], strict=False)]
        return out or [Slice("", 0, 0, 0, 0)]

    def read(self, part):
        fs, folder = store(self.path)
        dtype, n = self.index["dtype"], part.to - part.at
        if not n:
            return
        offsets = mapped(fs, f"{folder}/{part.name}.offsets", "<u8", part.at, n + 1).astype(np.int64)
        keys = mapped(fs, f"{folder}/{part.name}.docs", "<i8", part.at, n)
        row = 0
        while row < n:  # a batch of some MB at a time; a longer document alone
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEND_BYTES // 4, "right")) - 1)
            ends = offsets[row : to + 1]
            ids = mapped(fs, f"{folder}/{part.name}.ids", dtype, int(ends[0]), int(ends[-1] - ends[0])).astype("<u4").tobytes()
            at = (ends - ends[0]) * 4
            null = np.arange(part.at + row, part.at + to) < part.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row:to].astype(np.int64), mask=null), pa.array(part.base + ends[:-1]), pa.array(np.diff(ends)),
                 pa.array([ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"])
            row = to


class TokenIds(DataSource):
    """``token_ids``: writes (doc_id, ids) in the order of the rows, reads ``SCHEMA``; ids come as unsigned 32-bit integers."""

    @classmethod
    def name(cls):
        return "token_ids"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], self.options["dtype"])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, *, key: str = "doc_id", text: str = "text") -> None:
    """The ids of all ``docs`` in ascending order of ``key`` (a long), in files in the folder ``path``."""
    spark = prepare(docs.sparkSession)
    spark.dataSource.register(TokenIds)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("__tie", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("__tie"), F.asc("__row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dtype = id_type(load(tokenizer_path).get_vocab_size(with_added_tokens=True))
    encode(rows, tokenizer_path, end_id).write.format("token_ids").option("dtype", dtype).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of a folder that ``write`` made, with ``start``: the ids of all documents before it."""
    prepare(spark)
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").load(path)
