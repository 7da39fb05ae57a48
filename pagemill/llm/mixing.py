"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions. Defined results:

* The mix holds ``share`` of all words. Sources are ordered by code point, null last, and weigh
  ``weights``, repeating. A target is its source's weighted share, at most ``epochs`` times its words;
  what a cap frees goes to the sources below their caps by weight, until none is above.
* A source takes every document ``floor(target / words)`` times; for the rest it takes documents in the
  order of a seeded hash of their id as long as at least half of the next one fits. So its words differ
  from the target by half a document at most, and reruns agree.
* Null text has size 0, and a source without words takes nothing; null ids and null sources are ids and a source like any other; repeated rows are
  rows of their own; an empty table gives an empty result. Extra columns pass through ``mix``; the columns
  it adds replace input columns of the same name (``__mix_…`` names are its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small

SEED = "mix-1"
#: A plan of this many sources (a row of some 60 bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """Adds ``__mix_size`` (words) and ``__mix_order`` (the seeded hash that orders a source's documents)."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumns({"__mix_size": words, "__mix_order": order})


def source_targets(sizes: DataFrame, share: float, epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """``(source, words)`` → the same with ``target``: capped water-filling in closed form.

    Sources sorted by cap per weight fill up in that order; before source i the level is
    (budget − caps so far) / (weights left), and the first source whose cap lies above its level fixes the
    level for all that follow. The table has one row per source, so its windows run in one small task.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_cap = Window.orderBy("__r", "__i")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("__i", F.row_number().over(ranked) - 1)
    t = t.withColumn("__w", weight).withColumn("__cap", F.col("words") * F.lit(float(epochs)))
    t = t.withColumn("__r", F.col("__cap") / F.col("__w"))
    t = t.withColumn("__budget", F.sum("words").over(everything) * F.lit(float(share)))
    t = t.withColumn("__level", (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
                     / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    t = t.withColumn("__level", F.max(F.when(F.col("__r") > F.col("__level"), F.col("__level"))).over(everything))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))
    return t.select("source", "words", target.alias("target"))


def plan(rows: DataFrame, source: str, share: float, epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """Per source: words, target, whole repetitions, words still wanted, and the bucket where they run out.

    A source is cut into 4,096 buckets by the first hash digits; sums per bucket are all that is
    shuffled, so a source with a third of all rows costs as little as any other.
    """
    buckets = rows.groupBy(F.col(source).alias("source"), F.substring("__mix_order", 1, 3).alias("bucket"))
    buckets = cut(buckets.agg(F.sum("__mix_size").alias("words")))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("words")), share, epochs, weights)
    sources = sources.withColumn("whole", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int"))
    sources = cut(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("words")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = buckets.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    filled = filled.withColumnsRenamed({"source": "s", "words": "in_bucket"})
    edge = filled.join(sources, F.col("s").eqNullSafe(F.col("source")))
    # the last bucket that begins at or below the wanted words is the only one that is taken in part
    edge = edge.where(F.col("before") <= F.col("rest")).groupBy("s").agg(
        F.max("bucket").alias("bucket"), F.max("before").alias("before"))
    edge = edge.withColumnRenamed("s", "e")
    joined = sources.join(edge, F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    return joined.select([F.col(c).alias(f"__mix_{c}") for c in joined.columns])


def decide(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
           epochs: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` (its source's) and ``repeats`` (0 or more)."""
    rows = sized(docs, key, text, seed)
    sources = cut(plan(rows, source, share, epochs, weights))
    rows = rows.join(small(sources, BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("__mix_source")))
    here = F.substring("__mix_order", 1, 3)
    wanted = F.col("__mix_rest") > 0
    clear = rows.where(here != F.col("__mix_bucket")).withColumn("__mix_more", (wanted & (here < F.col("__mix_bucket"))).cast("int"))
    running = Window.partitionBy("__mix_source").orderBy("__mix_order", "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(here == F.col("__mix_bucket"))
    start = F.col("__mix_before") + F.coalesce(F.sum("__mix_size").over(running), F.lit(0))
    edge = edge.withColumn("__mix_more", (wanted & (start + F.col("__mix_size") / 2 <= F.col("__mix_rest"))).cast("int"))
    both = clear.unionByName(edge)
    added = {"size": F.col("__mix_size"), "source_size": F.col("__mix_words"), "target": F.col("__mix_target"),
             "repeats": F.col("__mix_whole") + F.col("__mix_more")}
    kept = [c for c in docs.columns if c not in added and not c.startswith("__mix_")]
    return both.select(*[F.col(c) for c in kept], *[v.alias(k) for k, v in added.items()])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each repetition, with ``repetition`` from 1 beside the columns of ``docs``."""
    rows = decide(docs, **options)
    extra = [c for c in ("size", "source_size", "target", "repetition") if c not in docs.columns]
    rows = rows.where(F.col("repeats") > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return rows.select(*[c for c in rows.columns if c in docs.columns and c != "repetition"], *extra)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CAST(CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(words AS DOUBLE) * 2.0 AS cap FROM i),
r AS (SELECT *, cap / w AS r FROM w),
l AS (
  SELECT *, (CAST(sum(words) OVER () AS DOUBLE) * 1.5
             - coalesce(sum(cap) OVER (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM r),
t AS (
  SELECT source, words, least(cap, coalesce(max(CASE WHEN r > level THEN level END) OVER () * w, cap)) AS target FROM l),
p AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.*, p.words, p.target, p.whole, p.target - p.whole * p.words AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, words AS source_size, target,
       CAST(size * (whole + CASE WHEN before + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
