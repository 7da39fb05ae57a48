"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of ``size`` consecutive words of a benchmark item (an item of fewer words, but not
none, is one pattern). Patterns of one length share a shift table over blocks of two words: it says how far
the search may jump when the block under its end occurs nowhere, or only early, in the patterns. Where the
shift is zero, the block's bucket lists the patterns that end in it, and direct comparison confirms them.

Words are runs of characters other than ASCII non-alphanumerics, with A-Z lower-cased; everything works on
UTF-8 bytes, where that rule needs no decoding.

Defined results: null text has no words; null ids are left out of the lists of items (their words still
count as hits); repeated items count once; empty tables give empty results or nothing hit; texts are
searched whole, a piece of a long one at a time is never needed as its words are a flat list. Extra
columns pass through and lose to the added names.

A benchmark of more than ``round_bytes`` is searched for in rounds, one round's tables at a time: each reads the texts, and all but
the last write what they found, by the hash of the text, to the shared folder. The last one joins that to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, lean, prepare

#: ASCII bytes that separate words become spaces, A-Z become a-z; bytes from 0x80 belong to words.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of benchmark text in one broadcast; a larger benchmark is searched for in several rounds of that size
#: (a worker's tables take some twenty times as much).
ROUND_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def spread(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each begin to its end."""
    sizes = ends - begins
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Table:
    """Shift table and suffix buckets of the patterns of one length, as sorted arrays.

    A pattern is a place in ``flat``, the items' words as numbers. A block is the numbers of two words (of one, for patterns of one
    word). A bucket holds the patterns with one last block, sorted by their first one.
    """

    def __init__(self, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, base: int):
        """``begins`` and ``ends``: where the items whose patterns have this length lie in ``flat``."""
        self.flat, self.length = flat, length
        starts = spread(begins, ends - length + 1)
        self.base, self.far = (base if length > 1 else 0), max(1, length - 1)
        block = lambda ends: flat[ends - 2] * self.base + flat[ends - 1] if length > 1 else flat[ends - 1]
        last, first = block(starts + length), block(starts + min(2, length))
        order = np.lexsort((first, last))
        self.starts, self.first = starts[order], first[order]
        self.blocks, at = np.unique(last[order], return_index=True)
        self.bucket = np.append(at, len(order))
        # the least shift of each block: a block that ends an item's t-th word is t words into its earliest pattern, or ends one
        off = min(2, length)
        inside = spread(begins + off, ends + 1)
        shifts = np.maximum(0, length - (inside - np.repeat(begins, ends + 1 - begins - off)))
        codes = block(inside)
        order = np.lexsort((shifts, codes))
        self.known, at = np.unique(codes[order], return_index=True)
        self.shifts = shifts[order][at]

    def found(self, numbers: np.ndarray):
        """(end, starts of the patterns that end there) of each occurrence; ``numbers``: a text's words, 0 for others."""
        n, length = len(numbers), self.length
        if n < length:
            return
        if length > 1:
            blocks = np.where((numbers[:-1] > 0) & (numbers[1:] > 0), numbers[:-1] * self.base + numbers[1:], 0)
        else:
            blocks = numbers
        shift = np.full(len(blocks), self.far)
        some = np.flatnonzero(blocks)
        at = np.minimum(np.searchsorted(self.known, blocks[some]), len(self.known) - 1)
        hit = self.known[at] == blocks[some]
        shift[some[hit]] = self.shifts[at[hit]]
        jumps, off, end = shift.tolist(), min(2, length), length
        while end <= n:
            jump = jumps[end - off]
            if jump == 0:
                jump = 1
                k = int(np.searchsorted(self.blocks, blocks[end - off]))
                lo, hi = self.bucket[k], self.bucket[k + 1]
                head = blocks[end - length]
                lo, hi = lo + np.searchsorted(self.first[lo:hi], head), lo + np.searchsorted(self.first[lo:hi], head, "right")
                text = numbers[end - length : end]
                for at in range(lo, hi, 4096):  # direct comparison
                    some = self.starts[at : min(hi, at + 4096)]
                    same = some[(self.flat[some[:, None] + np.arange(length)] == text).all(1)]
                    if len(same):
                        yield end, same
            end += jump


class Patterns:
    """The patterns of some items, a table for each length."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.ids: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        numbers = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int64) for _, text in items]
        sizes = np.array([len(x) for x in numbers], np.int64)
        self.ends = np.cumsum(sizes)
        flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
        lengths = np.minimum(size, sizes)
        self.tables = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            ends = self.ends[lengths == length]
            self.tables.append(Table(flat, ends - sizes[lengths == length], ends, length, len(self.ids) + 1))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words inside occurrences, and the items whose patterns occur."""
        get = self.ids.get
        numbers = np.array([get(w, 0) for w in words], np.int64)
        spans, items = [], set()
        for table in self.tables:
            for end, starts in table.found(numbers):
                spans.append((end - table.length, end))
                items.update(np.searchsorted(self.ends, starts, "right").tolist())
        return spans, {self.items[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def rounds(benchmark: DataFrame, item: str, text: str, most: int):
    """The benchmark in lists of at most ``most`` bytes (one item at least), two of them on the driver at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    some, held = [], 0
    for row in rows.where("t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator():
        if some and held + len(row.t) > most:
            yield some
            some, held = [], 0
        some.append((row.i, bytes(row.t)))
        held += len(row.t)
    yield some


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def searching(shared, size: int, whole: bool):
    """Batches with a text last → the number of its words, items and spans in its place; only texts that hold any, if not ``whole``."""
    def search(batches):
        patterns = Patterns(shared.value, size)
        for batch in batches:
            k = batch.num_columns - 1
            counts, items, hits, rows = [], [], [], []
            for i, value in enumerate(batch.column(k)):
                words = words_of(value.as_py())
                spans, which = patterns.search(words)
                if whole or spans:
                    rows.append(i)
                    counts.append(len(words))
                    items.append(sorted(w for w in which if w is not None))
                    hits.append([{"start": a, "end": b} for a, b in merged(spans)])
            kept = batch.select(batch.schema.names[:k]).take(pa.array(rows, pa.int64()))
            made = [pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, "n_words", "items", "hits"])
    return lean(search)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id",
                   item_text: str = "text", size: int = 10, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (occurring item ids as strings, sorted), ``hits`` (merged
    spans of word numbers) and ``contaminated``."""
    spark = prepare(docs.sparkSession).sparkContext
    names = ("n_words", "n_hit", "items", "hits", "contaminated")
    found = T.StructType().add("n_words", "long").add("items", T.ArrayType(T.StringType())).add("hits", FOUND)
    rest = rounds(benchmark, item, item_text, round_bytes)
    now, after = next(rest), next(rest, None)
    # every round but the last finds the texts that hold some of its items; what it found is written, by the text's hash
    earlier, last, which = None, None, F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("__which")
    while after is not None:
        shared = spark.broadcast(now)
        rows = docs.select(which, F.col(text).cast("binary").alias("__text"))
        part = rows.mapInArrow(searching(shared, size, False), T.StructType([T.StructField("__which", T.BinaryType()), *found]))
        part = part.groupBy("__which").agg(F.first("items").alias("items"), F.first("hits").alias("hits"))
        done = Stored(part if earlier is None else earlier.unionByName(part))
        shared.destroy()
        if last:
            last.drop()
        earlier, last = done.read(), done
        now, after = after, next(rest, None)
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*[c for c in kept if c != text], *([which] if earlier is not None else []),
                       *([F.col(text).alias("__kept")] if text in kept else []), F.col(text).cast("binary").alias("__text"))
    shared = spark.broadcast(now)
    schema = T.StructType([*rows.drop("__text").schema, *found])
    rows = rows.mapInArrow(searching(shared, size, True), schema)
    if earlier is not None:
        both = earlier.groupBy("__which").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"),
                                              F.flatten(F.collect_list("hits")).alias("__hits"))
        rows = rows.join(both, "__which", "left").withColumn("items", F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__items", F.array())))))
        rows = rows.withColumn("hits", joined(F.concat("hits", F.coalesce("__hits", F.array().cast(FOUND)))))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    order = [F.col("__kept").alias(text) if c == text else F.col(c) for c in kept]
    return rows.select(*order, "n_words", "items", "hits", n_hit.alias("n_hit"), (F.size("hits") > 0).alias("contaminated"))


def joined(spans):
    """Spans as few as hold the same words, in order."""
    def step(done, s):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(FOUND), step)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM pat),
win AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT * FROM d, sizes WHERE len(w) >= n) AS x, unnest(range(1, len(w) - n + 2)) AS t(p)),
found AS (SELECT r, p, win.n AS n, item_id FROM win JOIN pat ON win.s = pat.s AND win.n = pat.n),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + n)) AS t(q) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) AS y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
