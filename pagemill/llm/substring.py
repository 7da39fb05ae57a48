"""Substring dedup by level-wise doubling: what repeats at one length alone is extended to twice that length.

A word is removed if a window of ``window`` consecutive words that covers it also starts anywhere else.

Levels. The lengths halve from ``window`` down (35: 18, then 35). A window can only repeat if the shorter
windows in it do, so each level looks only at what the level before left, until the last level's windows
are known. The first level need not look at all short windows: of each full window it takes the one with
the smallest hash. That choice depends on the window's words alone, so two equal windows choose equal
short windows at equal places, and none is missed, though only an eighth of all short windows is dealt out.

Spark's work. A level deals the hashes by hash, sorts them, and marks hashes that occur twice; marks go back
to their rows by key and join the texts. A task first counts its own hashes: of one that it met twice it
deals out a single witness, so a passage that a third of all rows share stays small, and marking reads a
sorted stream, so no task ever holds a group. Equal texts are known by one hash of the whole text; one of
them takes part in the later levels. Both joins read one shuffle of the texts.

Words are equal if 64-bit hashes of their windows are, from word hashes combined by doubling. Defined
results: null and empty texts have no words; repeated rows are copies; ids may be null; an empty table gives
an empty result; extra columns pass through and lose to the added names (``__…`` names are the operator's).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, prepare

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
#: What a dealt hash still needs: to be seen again; nothing, but others need it; nothing at all; no mark of its own.
ASK, WITNESS, KNOWN, SILENT = 0, 1, 2, 3
#: Marks below zero: the whole text has a copy; the same, and this row stands for all copies.
COPY, LEADER = -1, -2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = int(ODD)
    inverse = pow(base, -1, 1 << 64)
    one = np.ones(n, np.uint64)
    one[1:] = np.uint64(base)
    other = np.ones(n, np.uint64)
    other[1:] = np.uint64(inverse)
    return np.multiply.accumulate(one), np.multiply.accumulate(other)


class Hasher:
    """Hashes of the words in a run of texts, computed over the bytes at once."""

    def __init__(self):
        self.values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = powers(PIECE)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, first word of each text and the number of all)."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        space = SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = ~space
        starts[1:] &= space[:-1] | edge[1:-1]
        ends = ~space
        ends[:-1] &= space[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
            low, high = starts[at], ends[to - 1]
            if high - low > len(self.up):
                self.up, self.down = powers(int(high - low))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.values[data[low:high]] * self.up[: high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64)
            at = to
        return mixed(out), np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, by doubling; the last step overlaps."""
    now, have = hashes, 1
    while have < length:
        step = min(have, length - have)
        if len(now) <= step:
            return np.zeros(0, np.uint64)
        now = mixed(now[:-step] * ODD + (now[step:] ^ (now[step:] >> np.uint64(29))) + np.uint64(have + step))
        have += step
    return now


def sliding(values: np.ndarray, length: int, pick) -> np.ndarray:
    now, have = values, 1
    while have < length and len(now):
        step = min(have, length - have)
        now = pick(now[:-step], now[step:])
        have += step
    return now


def smallest(short: np.ndarray, window: int, length: int) -> np.ndarray:
    """For every full window of one text, the smallest hash of the short windows in it."""
    return sliding(short, window - length + 1, np.minimum)


def texts_of(batch: pa.RecordBatch, column: int):
    """Runs of texts of about ``PIECE`` bytes: (first row, bytes, offsets)."""
    values = pc.fill_null(batch.column(column), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def dealt(hashes, states, first, second, places) -> pa.RecordBatch:
    """Rows to deal out, after one task's copies of a hash are put together."""
    order = np.lexsort((states == ASK, hashes))
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=group[-1] + 1 if len(group) else 0)[group] > 1
    state = states[order]
    witnessed = np.zeros(len(h), bool)
    if len(h):
        witnessed = np.maximum.reduceat((state != ASK).astype(np.int8), np.flatnonzero(new))[group] > 0
    asks = state == ASK
    state = np.where(asks & (several | witnessed), np.where(new, WITNESS, KNOWN), state)
    keep = ~((state == SILENT) & ~new)  # one witness of a hash is enough
    # what needs nothing more goes straight to its row's key, spread evenly
    route = np.where(state == KNOWN, mixed(first[order].view(np.uint64)), h)
    return pa.RecordBatch.from_pydict({
        "hash": route[keep].view(np.int64), "state": state[keep].astype(np.int8), "first": first[order][keep],
        "second": second[order][keep], "place": places[order][keep].astype(np.int32)})


DEALT = "hash long, state tinyint, first long, second long, place int"
MARKED = "first long, second long, place int"


def first_level(window: int, length: int):
    """Of (first, second, text): the short windows to ask for, and the hash of each whole text."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            hashes, rows, places = [], [], []
            for row, data, offsets in texts_of(batch, 2):
                words, at = hasher.words(data, offsets)
                short = windows(words, length)
                for k in range(len(offsets) - 1):
                    n = at[k + 1] - at[k]
                    if n < window:
                        continue
                    mine = short[at[k] : at[k + 1] - length + 1]
                    least = smallest(mine, window, length)
                    pad = np.zeros(window - length, np.uint64)
                    chosen = np.flatnonzero(sliding(np.concatenate((pad, least, pad)), window - length + 1, np.maximum) == mine)
                    hashes.append(mine[chosen])
                    places.append(chosen)
                    rows.append(np.full(len(chosen) + 1, row + k))
                    hashes.append(mixed(two[row + k : row + k + 1].view(np.uint64) ^ ODD))
                    places.append(np.array([COPY]))
            if hashes:
                rows = np.concatenate(rows)
                h = np.concatenate(hashes)
                yield dealt(h, np.zeros(len(h), np.int8), one[rows], two[rows], np.concatenate(places))
    return run


def candidates(words: np.ndarray, marks: np.ndarray, window: int, length: int) -> np.ndarray:
    """Full windows whose smallest short window is marked."""
    short = windows(words, length)
    return np.flatnonzero(np.isin(smallest(short, window, length), short[marks]))


def next_level(window: int, length: int, before: int, first: bool):
    """Of (first, second, marks, …, text): the windows of ``length`` that the marks of the level before leave."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            marks = batch.column(2)
            hashes, rows, places, states = [], [], [], []

            def add(row, h, p, state):
                hashes.append(h)
                places.append(p)
                rows.append(np.full(len(p), row))
                states.append(np.full(len(p), state, np.int8))

            for row, data, offsets in texts_of(batch, batch.num_columns - 1):
                words, at = hasher.words(data, offsets)
                for k in range(len(offsets) - 1):
                    mine = words[at[k] : at[k + 1]]
                    mark = marks[row + k].values.to_numpy(zero_copy_only=False)
                    leader = LEADER in mark  # repeated rows share a key: the first of them may stand for all
                    copy = COPY in mark and not leader
                    if copy or leader:
                        add(row + k, mixed(np.array([row + k], np.uint64)), np.array([LEADER if leader else COPY]), KNOWN)
                    if len(mine) < window or copy:
                        continue
                    mark = mark[mark >= 0]
                    if leader:
                        found = np.arange(len(mine) - window + 1)
                    else:
                        found = candidates(mine, mark, window, before) if first else np.sort(mark)
                    add(row + k, windows(mine, length)[found], found, SILENT if leader else ASK)
            if hashes:
                rows = np.concatenate(rows)
                yield dealt(np.concatenate(hashes), np.concatenate(states), one[rows], two[rows], np.concatenate(places))
    return run


def marking(batches):
    """Rows sorted by hash and state → the rows whose hash occurs again, a sorted stream at a time."""
    held = None  # the last row of what came before, undecided, and whether a row before it has its hash

    def decided(cols, again):
        state, place = cols["state"], cols["place"]
        told = (state == WITNESS) | (state == KNOWN) | (again & (state == ASK))
        return pa.RecordBatch.from_pydict({"first": cols["first"][told], "second": cols["second"][told], "place": place[told]})

    seen = False
    for batch in batches:
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(("hash", "state", "first", "second", "place"))}
        if held is not None:
            cols = {n: np.concatenate((held[n], v)) for n, v in cols.items()}
        n = len(cols["hash"])
        if not n:
            continue
        h, shared = cols["hash"], cols["state"] != KNOWN
        same = (h[1:] == h[:-1]) & shared[1:] & shared[:-1]
        earlier = np.concatenate(([seen], same))
        later = np.concatenate((same, [False]))
        again = earlier | later
        # of the copies of a text, the first stands for all
        told = (cols["state"] == WITNESS) | again
        lead = (cols["place"] == COPY) & shared & told & ~earlier
        cols["place"] = np.where(lead, LEADER, cols["place"]).astype(np.int32)
        last = n - 1
        yield decided({k: v[:last] for k, v in cols.items()}, again[:last])
        held = {k: v[last:] for k, v in cols.items()}
        held["place"] = np.where(held["place"] == LEADER, COPY, held["place"]) if lead[last] else held["place"]
        seen = bool(earlier[last])
    if held is not None:
        again = np.array([seen])
        lead = (held["place"] == COPY) & (held["state"] == WITNESS) & ~again
        held["place"] = np.where(lead, LEADER, held["place"]).astype(np.int32)
        yield decided(held, again)


def removing(window: int):
    """Of (marks, …, text): the kept words joined by one space, and how many words there were and went."""
    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            texts, counts, gone = [], [], []
            for mark, value in zip(batch.column(0), batch.column(last), strict=True):
                words = (value.as_py() or b"").split()
                n = len(words)
                counts.append(n)
                if not mark.is_valid or n < window:
                    gone.append(0)
                    texts.append(b" ".join(words))
                    continue
                marks = mark.values.to_numpy(zero_copy_only=False)
                cover = np.zeros(n + 1, np.int64)
                if marks.min() < 0:
                    cover[0] = 1
                else:
                    np.add.at(cover, marks, 1)
                    np.add.at(cover, marks + window, -1)
                keep = np.cumsum(cover[:n]) == 0
                gone.append(n - int(keep.sum()))
                texts.append(b" ".join([words[i] for i in np.flatnonzero(keep)]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:last], pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                names=[*batch.schema.names[1:last], "__kept", "n_words", "n_removed"])
    return run


def levels(window: int, least: int = 16) -> list[int]:
    found = [window]
    while found[0] > 2 * least:
        found.insert(0, (found[0] + 1) // 2)
    return found if len(found) > 1 else [max(1, (window + 1) // 2), window]


def marks_of(level: DataFrame, parts: int) -> DataFrame:
    """Deals a level's hashes, marks those that occur again and gathers the marks of each row."""
    sorted_ = level.repartition(parts, "hash").sortWithinPartitions("hash", "state")
    marked = sorted_.mapInArrow(lean(marking), MARKED)
    return marked.groupBy(F.col("first").alias("__1"), F.col("second").alias("__2")).agg(F.collect_list("place").alias("__marks"))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words, and ``n_words`` and ``n_removed``."""
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", text) and not c.startswith("__")]
    rows = docs.select(F.xxhash64(key).alias("__first"), F.xxhash64(text).alias("__second"), *kept, F.col(text).cast("binary").alias("__text"))
    on = (F.col("__first") == F.col("__1")) & (F.col("__second") == F.col("__2"))
    lengths = levels(window)
    level = rows.select("__first", "__second", "__text").mapInArrow(lean(first_level(window, lengths[0])), DEALT)
    # the texts are dealt by key once; both joins read that shuffle
    texts = rows.repartition(parts, "__first", "__second")
    for i, length in enumerate(lengths[1:]):
        joined = texts.join(marks_of(level, parts), on)
        level = joined.select("__first", "__second", "__marks", *kept, "__text").mapInArrow(
            lean(next_level(window, length, lengths[i], i == 0)), DEALT)
    joined = texts.join(marks_of(level, parts), on, "left").select("__marks", *kept, "__text")
    schema = joined.drop("__marks", "__text").schema.add("__kept", "binary").add("n_words", "long").add("n_removed", "long")
    done = joined.mapInArrow(lean(removing(window)), schema)
    order = [F.col("__kept").cast("string").alias(text) if c == text else F.col(c) for c in docs.columns if c in kept or c == text]
    return done.select(*order, "n_words", "n_removed")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
win AS (
  SELECT r, p, array_to_string(w[p:p + 34], ' ') AS s
  FROM d, unnest(range(1, len(w) - 33)) AS t(p) WHERE len(w) >= 35),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, q FROM (SELECT r, p FROM win JOIN rep USING (s)) AS x, unnest(range(p, p + 35)) AS t(q)),
words AS (SELECT r, q, w[q] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(q)),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n
  FROM words ANTI JOIN hit USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
