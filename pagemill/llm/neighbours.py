"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt out into blocks of a bounded number by a hash of their ids, and every block gets the
queries, a bounded number at a time. A task projects its block on ``projections`` random lines and sorts
each line. A query opens a window around its own place on every line; a vector collides once for each line
on whose window it lies. Vectors that collide on at least ``share`` of the lines are verified: their exact
distance is computed. While fewer than ``k`` verified vectors lie within the radius the windows stand for, the
radius grows by ``growth`` (virtual rehashing: the windows widen in place, nothing is built anew) until all of
the block is verified. No other limit stops the search. The blocks' nearest are merged by rank.

Every row is indexed. A vector within the radius lies in a line's window with probability 0.82 (a window is
2.7 radii wide, a line's direction is Gaussian), so of 48 lines it misses 60 % with a chance of about 0.0003.

Defined results: rows without an id and vectors that are null, empty, zero or hold null or non-finite
components take no part; a row repeated with id and vector counts once, and a query never finds its own id;
vectors of another length than the query's are not compared with it; ties go to the smaller id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

BLOCK, CHUNK = 16_384, 2_048
PROJECTIONS, SHARE, WIDTH, GROWTH = 48, 0.6, 2.7, 1.25


class Lines:
    """A block's vectors, and their places on every line in sorted order."""

    def __init__(self, vectors: np.ndarray, k: int, projections: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.vectors, self.k = vectors, k
        self.directions = rng.normal(size=(vectors.shape[1], projections))
        places = (vectors @ self.directions).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, self.order, axis=1)
        sample = vectors[rng.permutation(len(vectors))[:32]]
        near = [np.partition(self.distances(v, vectors), min(k, len(vectors) - 1))[min(k, len(vectors) - 1)] for v in sample]
        self.radius = max(float(np.quantile(near, 0.2)), 1e-9 * float(np.abs(vectors).max()))

    @staticmethod
    def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors - query) ** 2).sum(1))

    def nearest(self, query: np.ndarray, ids: np.ndarray, own: int, share: float, width: float, growth: float):
        """(rows, distances) of the block's nearest to the query, ties to smaller ids."""
        n, lines = len(self.vectors), len(self.places)
        centre = query @ self.directions
        counts = np.zeros(n, np.int32)
        low = high = np.array([np.searchsorted(p, c) for p, c in zip(self.places, centre, strict=True)])
        least, radius = int(np.ceil(share * lines)), self.radius
        rows, far = np.zeros(0, np.int64), np.zeros(0)
        open_ = ids != own
        while True:
            half = radius * width / 2
            if n - len(rows) > 0 and half < np.inf:
                to_low = np.array([np.searchsorted(p, c - half, "left") for p, c in zip(self.places, centre, strict=True)])
                to_high = np.array([np.searchsorted(p, c + half, "right") for p, c in zip(self.places, centre, strict=True)])
                new = [o[a:b] for o, a, b in zip(self.order, to_low, low, strict=True)]
                new += [o[a:b] for o, a, b in zip(self.order, high, to_high, strict=True)]
                counts += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
                low, high = to_low, to_high
            found = np.flatnonzero((counts >= least) & open_)
            open_[found] = False
            if len(found):
                rows, far = np.concatenate((rows, found)), np.concatenate((far, self.distances(query, self.vectors[found])))
            if (far <= radius).sum() >= self.k or not open_.any():
                best = np.lexsort((ids[rows], far))[: self.k]
                return rows[best], far[best]
            radius *= growth


def valid(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest_neighbours(vectors: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding", k: int = 10,
                       block: int = BLOCK, chunk: int = CHUNK, projections: int = PROJECTIONS, share: float = SHARE,
                       width: float = WIDTH, growth: float = GROWTH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row that ``is_query`` marks."""
    prepare(vectors.sparkSession)
    rows = vectors.where(F.col(key).isNotNull() & valid(vector))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                       F.coalesce(is_query, F.lit(False)).alias("q"), F.size(vector).alias("size"))
    rows = cut(rows.dropDuplicates(["id", "v"]))
    n, queries = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-queries // chunk))
    place = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    stored = rows.select("size", place(blocks).alias("block"), every(chunks).alias("chunk"), "id", "v")
    asked = rows.where("q").groupBy("id", "size").agg(F.min("v").alias("v"))
    asked = asked.select("size", every(blocks).alias("block"), place(chunks).alias("chunk"), "id", "v")

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        found = [[out[0]], [out[1]], [out[2]]]
        if mine.num_rows and asked.num_rows:
            of = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            ids, vectors = mine.column("id").to_numpy(), of(mine)
            order = np.argsort(ids, kind="stable")  # the result doesn't depend on how rows arrive
            ids, lines = ids[order], Lines(vectors[order], k, projections)
            for query, v in zip(asked.column("id").to_numpy(), of(asked), strict=True):
                at, far = lines.nearest(v, ids, query, share, width, growth)
                for column, values in zip(found, (np.full(len(at), query), ids[at], far), strict=True):
                    column.append(values)
        q, i, s = map(np.concatenate, found)
        return pa.table({"query_id": q, "vec_id": i, "score": s})

    by = ("size", "block", "chunk")
    found = stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
