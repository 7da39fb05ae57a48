"""Periodic runs of words by recompression: a run-length grammar answers exact extensions for candidates on grids.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring word extends, of
``least`` words and ``times`` periods at least. Some documents' words at a time become one sequence of numbers, with a number
of its own between any two documents. Recompression alternates block compression (maximal blocks of one symbol become one
symbol) and pair compression (every symbol is left or right by a hash of it; each left one followed by a right one becomes one symbol)
until few symbols are left; equal words around a place are compressed equally, so the levels are a run-length
grammar of locally consistent cuts.

The longest common extension of two places climbs the levels while both stand at the same kind of cut, passing over at most
a few equal symbols on each, and then descends to the words that differ; leftwards it does the same on the mirrored
levels. All candidates go through a level together.

Candidates: a run of period q holds ``max(least, times * q) - q`` matching places (equal to the word q later) in a row, so
with a grid of half as many it holds two neighbouring grid places that match. The grids of all periods make some
n log n places. The extensions of each give a stretch exactly; of equal stretches the smallest period is its period.

Defined results: null texts have no words; empty and short texts have no runs; repeated rows, null ids and ties are rows like any
other; an empty table gives an empty result; extra columns pass through and lose to the added names. A text of any length
is one sequence; what a task holds grows with ``WORDS_AT_ONCE`` or its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, lean, mixed, prepare

#: Words whose grammar is built at a time (a longer text alone), candidates that are extended together, and the
#: symbols below which levels end (extensions that get there compare them one by one).
WORDS_AT_ONCE, CANDIDATES_AT_ONCE, FEW = 200_000, 1 << 18, 16


class Level:
    """Symbols, and for each its parent on the next level; ``first``: the first child of each parent, with an end."""

    __slots__ = ("symbols", "start", "parent", "first", "block")

    def __init__(self, symbols, start):
        self.symbols, self.start, self.parent, self.first, self.block = symbols, start, None, None, None

    def mirrored(self, n: int) -> Level:
        """This level read from the right; ``n``: words in all."""
        out = Level(self.symbols[::-1], n - np.append(self.start[1:], n)[::-1])
        if self.first is not None:
            parents, size = len(self.first) - 1, len(self.symbols)
            out.parent, out.first, out.block = parents - 1 - self.parent[::-1], size - self.first[::-1], self.block
        return out


def named(keys: np.ndarray) -> np.ndarray:
    """Equal keys, equal numbers from 0."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def recompress(words: np.ndarray) -> list[Level]:
    """Levels from the words up. Blocks and pairs alternate; a symbol's name stands for its content on that level."""
    levels, block = [Level(words.astype(np.int64), np.arange(len(words)))], True
    while len(levels[-1].symbols) > FEW and len(levels) < 400:
        at = levels[-1]
        s = at.symbols
        begins = np.ones(len(s), bool)
        if block:
            begins[1:] = s[1:] != s[:-1]
        else:
            side = mixed(s.astype(np.uint64) + np.uint64(len(levels) << 40)) & np.uint64(1)
            ups = np.count_nonzero((side[:-1] == 0) & (side[1:] == 1))
            left = 0 if 2 * ups >= np.count_nonzero(side[:-1] != side[1:]) else 1
            begins[1:] = (side[:-1] != left) | (side[1:] == left)
        first = np.append(np.flatnonzero(begins), len(s))
        sizes = np.diff(first)
        if block:
            names = named(s[first[:-1]] * (int(sizes.max()) + 1) + sizes)
        else:
            second = np.where(sizes == 2, s[np.minimum(first[:-1] + 1, len(s) - 1)] + 1, 0)
            names = named(s[first[:-1]] * (int(s.max()) + 2) + second)
        at.parent, at.first, at.block = np.cumsum(begins) - 1, first, block
        levels.append(Level(names, at.start[first[:-1]]))
        block = not block
    return levels


def extend(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from places ``i`` on equal those from ``j`` on (``i`` and ``j`` differ, an own number ends each document)."""
    a, b = i.copy(), j.copy()
    stopped = np.zeros(len(i), np.int64)  # the level where a mismatch was met
    active = np.arange(len(i))
    for number, level in enumerate(levels):
        s, first, parent = level.symbols, level.first, level.parent
        here, going = active, []
        while len(here):
            x, y = a[here], b[here]
            if first is not None:
                px, py = parent[x], parent[y]
                cut = (first[px] == x) & (first[py] == y)
                up = here[cut]
                a[up], b[up] = px[cut], py[cut]
                going.append(up)
                here, x, y, px, py = here[~cut], x[~cut], y[~cut], px[~cut], py[~cut]
            equal = s[x] == s[y]
            stopped[here[~equal]] = number
            here, x, y = here[equal], x[equal], y[equal]
            if first is not None and level.block:
                step = np.minimum(first[px[equal] + 1] - x, first[py[equal] + 1] - y)
            else:
                step = 1
            a[here], b[here] = x + step, y + step
        active = np.concatenate(going) if going else active[:0]
        if not len(active):
            break
    top = int(stopped.max(initial=0))
    for number in range(top, 0, -1):
        here = np.flatnonzero(stopped >= number)
        below = levels[number - 1]
        s, first = below.symbols, below.first
        x, y = first[a[here]], first[b[here]]
        step = np.minimum(first[a[here] + 1] - x, first[b[here] + 1] - y) if below.block else 1
        step = np.where(s[x] == s[y], step, 0)
        a[here], b[here] = x + step, y + step
    return a - i


def candidates(words: np.ndarray, ends: np.ndarray, least: int, times: int):
    """Places i and periods q where a run may be: ``ends`` are the ends of documents, longest first."""
    sizes = np.diff(ends, prepend=0) - 1
    places, periods, held = [], [], 0
    for q in range(1, int(sizes.max(initial=0)) // times + 1):
        need = max(least, times * q)
        n = int(ends[np.searchsorted(-sizes, -need, "right") - 1]) if sizes[0] >= need else 0
        grid = max(1, (need - q) // 2)
        if n <= q:
            break
        equal = words[: n - q : grid] == words[q:n:grid]
        hits = np.flatnonzero(equal[:-1] & equal[1:] if grid > 1 else equal) * grid
        if len(hits):
            places.append(hits)
            periods.append(np.full(len(hits), q))
            held += len(hits)
            if held >= CANDIDATES_AT_ONCE:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(documents: list[np.ndarray], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """Of each document's word numbers: its runs as rows (start, length, period), by start, then period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(documents)
    order = sorted((d for d in range(len(documents)) if len(documents[d]) >= least), key=lambda d: -len(documents[d]))
    if not order:
        return out
    highest = max(int(documents[d].max()) for d in order)
    parts = []
    for rank, d in enumerate(order):
        parts += [documents[d], [highest + 1 + rank]]
    words = np.concatenate(parts).astype(np.int64)
    ends = np.cumsum([len(documents[d]) + 1 for d in order])
    found, levels, mirror = [], None, None
    for i, q in candidates(words, ends, least, times):
        if levels is None:
            # an own number before all documents as well, so that the mirrored sequence ends with one
            levels = recompress(np.concatenate([[highest + 1 + len(order)], words]))
            mirror = [level.mirrored(len(words) + 1) for level in levels]
        right = extend(levels, i + 1, i + q + 1)
        left = extend(mirror, len(words) - i, len(words) - i - q)
        start, length = i - left, left + right + q
        good = length >= np.maximum(least, times * q)
        found.append(np.unique(np.stack([start[good], length[good], q[good]], 1), axis=0))
    if not found:
        return out
    rows = np.unique(np.concatenate(found), axis=0)
    if len(rows):
        same = np.zeros(len(rows), bool)
        same[1:] = (rows[1:, :2] == rows[:-1, :2]).all(1)
        rows = rows[~same]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    which = np.searchsorted(ends, rows[:, 0], "right")
    for rank in np.unique(which):
        mine = rows[which == rank].copy()
        mine[:, 0] -= ends[rank] - len(documents[order[rank]]) - 1
        out[order[rank]] = mine
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def find_runs(docs: DataFrame, *, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period), and ``collapsed``: the words that stay, joined by one space."""
    prepare(docs.sparkSession)
    names = ("runs", "collapsed")
    rows = docs.select(*[c for c in docs.columns if c not in names], F.col(text).cast("binary").alias("__text"))
    schema = rows.drop("__text").schema.add("runs", T.ArrayType(RUN)).add("collapsed", "string")

    def groups(texts):
        """Words of some texts at a time, with their numbers."""
        words, numbers, held = [], [], 0
        ids: dict[bytes, int] = {}
        for value in texts:
            w = (value.as_py() or b"").split()
            words.append(w)
            numbers.append(np.array([ids.setdefault(x, len(ids)) for x in w], np.int64) if len(w) >= least else np.zeros(0, np.int64))
            held += len(w)
            if held >= WORDS_AT_ONCE:
                yield words, numbers
                words, numbers, held, ids = [], [], 0, {}
        yield words, numbers

    def search(batches):
        for batch in batches:
            runs, collapsed = [], []
            for words, numbers in groups(batch.column(batch.num_columns - 1)):
                for w, found in zip(words, runs_of(numbers, least, times), strict=True):
                    if len(found):
                        w = [w[i] for i in np.flatnonzero(kept_words(len(w), found))]
                    runs.append(found)
                    collapsed.append(b" ".join(w))
            flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
            edges = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            column = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                             names=[*batch.schema.names[:-1], *names])

    return rows.mapInArrow(lean(search), schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties to the smallest start, then period (none: null)."""
    return F.aggregate(runs, F.lit(None).cast(RUN),
                       lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeating(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), a tenth of them by a hash of the id with one period of their words repeated to the end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    index = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("w", index(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


#: Every pair of equal words of a document at most a third of its words apart; stretches of neighbouring pairs.
ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
hashed AS (
  SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
           list_transform(list_filter(string_split(k, ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM given, crc),
placed AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
words AS (
  SELECT r, i, n, w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] AS x
  FROM placed, unnest(range(n)) AS u(i)),
pairs AS (SELECT p.r, p.i, s.i - p.i AS q FROM words AS p JOIN words AS s ON p.r = s.r AND p.x = s.x AND s.i > p.i AND s.i - p.i <= p.n // 3),
stretches AS (
  SELECT r, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS e FROM pairs)
  GROUP BY r, q, e HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, s, m, min(q) AS q FROM stretches GROUP BY r, s, m),
best AS (SELECT r, s, m, q FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(m AS DECIMAL(38, 18)) / q DESC, s, q) AS k FROM runs) WHERE k = 1),
lines AS (SELECT r, count(*) AS n_runs, string_agg(concat_ws(',', s, m, q) || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(s + q, s + m)) AS u(i)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.m AS length, best.q AS period, 1000 * best.m // best.q AS exponent_milli,
       sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM placed LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
