"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts gives each document's statistics, which are kept; everything else reads those.
cos(Wx + b) with Gaussian W approximates a Gaussian kernel over the standardised statistics. Every task sums
its rows' normal equations; the sums (a fixed number of rows a task, one for each feature) are added up
by feature in sorted streams, and the driver solves one system of ``features`` unknowns. Labelled rows of
fold 1 calibrate and the other learnable ones fit: raw scores are counted in a fixed number of bins, and pool
adjacent violators makes the label's rate in them monotone. All labelled rows take part, at any size.

Defined results: null texts count as empty, and empty texts get the score of their statistics; several labels
of an id count as their mean; without labels every score is 0.5; null ids have no label, and count as empty
text for folds; repeated rows are rows of their own; an empty table gives an empty result; extra columns
pass through and lose to the added names.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, cut, lean, prepare

FEATURES, GAMMA, RIDGE, BINS = 256, 0.06, 1e-3, 512


def shares(part, whole):
    return part / max(1, whole)


def statistics(text: bytes | None) -> list[float]:
    """What a text looks like, with no regard to its language; long texts whole."""
    text = text or b""
    n = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    m, k = len(words), len(lines)
    lengths = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1)
    upper, lower, digits, other = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum(), seen[128:].sum()
    stops = seen[[33, 39, 44, 46, 58, 59, 63]].sum()  # ! ' , . : ; ?
    symbols = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum() - stops
    odds = seen[seen > 0] / max(1, n)
    counts = Counter(words)
    top = counts.most_common(3)
    return [
        np.log1p(n), np.log1p(m), shares(upper, upper + lower), shares(digits, n), shares(other, n), shares(stops, m),
        shares(symbols, m), shares(seen[33], m), shares(seen[124], m), -float((odds * np.log2(odds)).sum()),
        float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), shares((lengths <= 3).sum(), m),
        shares(len(counts), m), shares(len(set(zip(words, islice(words, 1, None), strict=False))), m),
        shares(sum(map(eq, words, islice(words, 1, None))), m), shares(top[0][1] if top else 0, m),
        shares(sum(c for _, c in top), m), shares(len(set(lines)), k), shares(k, m), shares(seen[46] + seen[33] + seen[63], m),
    ]


WIDTH = len(statistics(b""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``__x``, the statistics."""
    prepare(docs.sparkSession)
    rows = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("binary").alias("__text"))

    def compute(batches):
        for batch in batches:
            k = batch.num_columns - 1
            x = pa.array([statistics(t.as_py()) for t in batch.column(k)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], x], names=[*batch.schema.names[:k], "__x"])

    return rows.mapInArrow(lean(compute), rows.drop("__text").schema.add("__x", T.ArrayType(T.DoubleType())))


def matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offset * WIDTH :].reshape(-1, WIDTH)[: len(column)] if len(column) else np.zeros((0, WIDTH))


class Kernel:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, gamma: float, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w, self.b = rng.normal(0, (2 * gamma) ** 0.5, (WIDTH, features)), rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.spread, -8, 8) @ self.w + self.b) * (2 / len(self.b)) ** 0.5
        return np.concatenate((z, np.ones((len(x), 1))), 1)


def normal_equations(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Sum of zz' and zy over all rows ``(__x, __y)``: (features + 1) by (features + 2)."""
    size = len(kernel.b) + 1
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(kernel)

    def sum_up(batches):
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        for batch in batches:
            z = shared.value(matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.concatenate((z, y[:, None]), 1)
        part = np.full(size, TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(part), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part", "v"])

    def add_up(batches):
        now, total = None, None
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                row = v.values.to_numpy(zero_copy_only=False)
                if i == now:
                    total = total + row
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"i": pa.array([now], pa.int64()), "v": pa.array([total], pa.list_(pa.float64()))})
                now, total = i, row
        if now is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array([now], pa.int64()), "v": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.select("__x", "__y").mapInArrow(sum_up, "i long, part long, v array<double>")
    sums = sums.repartition(min(size, int(spark.conf.get("spark.sql.shuffle.partitions"))), "i").sortWithinPartitions("i", "part")
    out = np.zeros((size, size + 1))
    for r in sums.mapInArrow(add_up, "i long, v array<double>").collect():
        out[r.i] = r.v
    return out


def monotone(centres: np.ndarray, rates: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and rates, to interpolate between."""
    blocks: list[list[float]] = []
    for c, r, w in zip(centres, rates, weights, strict=True):
        blocks.append([c * w, r * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(known: DataFrame, calibrating, features: int, gamma: float, ridge: float, bins: int):
    """Of ``(__x, __y, …)``: the kernel, its weights, and the calibration's two rows; None without rows."""
    at = [F.col("__x")[i] for i in range(WIDTH)]
    m = known.agg(F.count("*"), *[F.avg(a) for a in at], *[F.stddev_pop(a) for a in at]).first()
    if not m[0]:
        return None
    kernel = Kernel(np.array(m[1 : WIDTH + 1]), np.maximum(np.array(m[WIDTH + 1 :]), 1e-6), features, gamma)
    sums = normal_equations(known.where(~calibrating), kernel)
    if not sums[-1, -2]:  # no row to fit by: all rows calibrate and fit
        sums = normal_equations(known, kernel)
    weights = np.linalg.solve(sums[:, :-1] + np.eye(len(sums)) * ridge * max(1.0, sums[-1, -2]) / len(sums), sums[:, -1])
    shared = known.sparkSession.sparkContext.broadcast((kernel, weights))

    def binned(batches):
        k, w = shared.value
        for batch in batches:
            raw = k(matrix(batch.column(0))) @ w
            yield pa.RecordBatch.from_pydict({"bin": np.clip(np.floor((raw + 0.5) * bins / 2), 0, bins - 1).astype(np.int64),
                                              "y": batch.column(1).to_numpy(zero_copy_only=False)})

    for rows in (known.where(calibrating), known):
        counts = rows.select("__x", "__y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
        found = sorted(counts.collect())
        if found:
            break
    b, y, n = (np.array(v, float) for v in zip(*found, strict=True))
    return kernel, weights, *monotone((b + 0.5) * 2 / bins - 0.5, y, n)


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          threshold: float = 0.3, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, bins: int = BINS) -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted``; only rows with ``crc32(key) mod 5 <> 0`` are learnt from."""
    fields = ("score", "predicted")
    rows = cut(with_statistics(docs.select(*[c for c in docs.columns if c not in fields]), text))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.avg(F.col(label).cast("double")).alias("__y"))
    known = rows.where(crc32_mod(key, 5) != 0).join(known, F.col(key) == F.col("__key"))
    known = cut(known.select("__x", "__y", (crc32_mod(key, 5) == 1).alias("__fold")))
    model = docs.sparkSession.sparkContext.broadcast(fit(known, F.col("__fold"), features, gamma, ridge, bins))

    def apply(batches):
        for batch in batches:
            k = batch.num_columns - 1
            if model.value is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                kernel, weights, centres, rates = model.value
                raw = kernel(matrix(batch.column(k))) @ weights
                # the raw score orders what calibration holds equal
                p = 0.999 * np.interp(raw, centres, rates) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             names=[*batch.schema.names[:k], *fields])

    return rows.mapInArrow(lean(apply), rows.drop("__x").schema.add("score", "double").add("predicted", "integer"))


def held_out(key: str):
    return crc32_mod(key, 5) == 0
