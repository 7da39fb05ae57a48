"""Page-local interval operators, all linear in the tokens of a page.

Containment questions ("is this token inside a removed element?", "how much
text is inside this element?", "which heading owns this text?") are answered
with one sort per page and running aggregates, never with a range join: a
range join would pair every token with every element of its page.

All helpers keep ``page_id`` as the leading partition key. In the plans of a
``page_session`` unions keep the partitioning of their inputs, so they add no
exchange of tokens (tests/test_plans.py counts them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = (Window.unboundedPreceding, Window.currentRow)


def dealt(df: DataFrame, keep: list[str], *rows: Column) -> DataFrame:
    """``keep`` and the fields of each of the structs ``rows``, a row for each: ``df`` is read once, where a union of
    its begins and ends would compute it twice. The array has a projection of its own, so that generated code fills it;
    ``outer``, as an inferred filter on its size would compute it again (it is never empty)."""
    return df.select(*keep, F.array(*rows).alias("_rows")).select(*keep, F.explode_outer("_rows").alias("_r")).select(*keep, "_r.*")


def sweep_keep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows of ``points(page_id, pos, ...)`` not covered by any half-open
    ``intervals(page_id, open_pos, stop_pos)``.

    Events (+1 at ``open_pos``, -1 at ``stop_pos``) are merged into the token
    stream; a running sum > 0 means "inside a removed subtree". Overlapping and
    nested intervals are handled by the counting.
    """
    cols = [c for c in points.columns]
    ev = dealt(intervals, ["page_id"], *[F.struct(F.col(c).alias("pos"), F.lit(d).alias("_d")) for c, d in (("open_pos", 1), ("stop_pos", -1))])
    pts = points.withColumn("_d", F.lit(0)).withColumn("_pt", F.lit(1))
    ev = ev.withColumn("_pt", F.lit(0))
    for c in cols:
        if c not in ("page_id", "pos"):
            ev = ev.withColumn(c, F.lit(None).cast(points.schema[c].dataType))
    u = pts.unionByName(ev.select(*pts.columns))
    w = Window.partitionBy("page_id").orderBy("pos", "_pt").rowsBetween(*RUN)
    return (u.withColumn("_cover", F.sum("_d").over(w))
            .filter((F.col("_pt") == 1) & (F.col("_cover") == 0))
            .select(*cols))


def interval_sums(points: DataFrame, intervals: DataFrame, weights: list[str]) -> DataFrame:
    """Sum ``weights`` of ``points(page_id, pos, w...)`` strictly inside each
    ``intervals(page_id, open_pos, end_pos)`` -> ``(page_id, open_pos, w...)``.

    Probe rows at ``open_pos`` (after the point there) and ``end_pos`` (before
    the point there) read the running sums; inside = end probe - open probe.
    Points without any weight add nothing and are left out before the sort.
    """
    points = points.filter(" OR ".join(f"{w} <> 0" for w in weights))
    pts = points.select("page_id", "pos", F.lit(1).alias("_sub"), F.lit(None).cast("int").alias("_el"),
                        F.lit(None).cast("string").alias("_side"), *[F.col(w).cast("long").alias(w) for w in weights])
    zero = [F.lit(0).cast("long").alias(w) for w in weights]
    probes = dealt(intervals, ["page_id"], *[
        F.struct(F.col(at).alias("pos"), F.lit(sub).alias("_sub"), F.col("open_pos").alias("_el"), F.lit(side).alias("_side"))
        for at, sub, side in (("open_pos", 2, "o"), ("end_pos", 0, "e"))]).select("*", *zero)
    u = pts.unionByName(probes)
    w = Window.partitionBy("page_id").orderBy("pos", "_sub").rowsBetween(*RUN)
    u = u.select("page_id", "_el", "_side", *[F.sum(c).over(w).alias(c) for c in weights])
    probes = u.filter(F.col("_el").isNotNull())
    agg = [(F.max(F.when(F.col("_side") == "e", F.col(c))) - F.max(F.when(F.col("_side") == "o", F.col(c)))).alias(c)
           for c in weights]
    return probes.groupBy("page_id", F.col("_el").alias("open_pos")).agg(*agg)


def assign_owner(points: DataFrame, owners: DataFrame, prefix: str = "owner", with_end: bool = False) -> DataFrame:
    """Attach to each ``points(page_id, pos, ...)`` row the innermost
    ``owners(page_id, open_pos, end_pos)`` element that contains it.

    Returns points with ``{prefix}_open`` (and ``{prefix}_end``); points with no owner are dropped.
    """
    cols = points.columns
    pts = points.withColumn("_ow", F.lit(None).cast(SPAN)).withColumns({"_k": F.lit(1), "_d": F.lit(0)})
    span = F.struct(F.col("open_pos").cast("int").alias("o"), F.col("end_pos").cast("int").alias("e"))
    # at one position: ends first, then points, then begins (a point is not inside an owner that begins at it)
    ow = dealt(owners, ["page_id"],
               F.struct(F.col("open_pos").cast("int").alias("pos"), span.alias("_ow"), F.lit(2).alias("_k"), F.lit(1).alias("_d")),
               F.struct(F.col("end_pos").cast("int").alias("pos"), F.lit(None).cast(SPAN).alias("_ow"),
                        F.lit(0).alias("_k"), F.lit(-1).alias("_d")))
    for c in cols:
        if c not in ("page_id", "pos"):
            ow = ow.withColumn(c, F.lit(None).cast(points.schema[c].dataType))
    u = _innermost(pts.unionByName(ow.select(*pts.columns))).filter("_cur IS NOT NULL")
    return u.select(*cols, F.col("_cur.o").alias(f"{prefix}_open"), *([F.col("_cur.e").alias(f"{prefix}_end")] if with_end else []))


SPAN = "struct<o:int,e:int>"


def _innermost(u: DataFrame, keep: bool = False) -> DataFrame:
    """Points among ``u(page_id, pos, _k, _d, _ow, ...)`` with ``_cur``, the innermost owner that contains them.

    Owners may nest: depth counts the owners that are open at a row, and the
    last owner opened at that depth is the innermost one. The second window
    sorts anew inside the page partitioning of the first, without a shuffle,
    and only what is inside an owner: no owner is open at depth 0. ``keep``: points outside too.
    """
    w = Window.partitionBy("page_id").orderBy("pos", "_k").rowsBetween(*RUN)
    u = u.withColumn("_lvl", F.sum("_d").over(w)).filter("_k > 0" if keep else "_k = 2 OR (_k = 1 AND _lvl > 0)")
    by_depth = Window.partitionBy("page_id", "_lvl").orderBy("pos", "_k").rowsBetween(*RUN)
    u = u.withColumn("_cur", F.last("_ow", ignorenulls=True).over(by_depth)).filter("_k = 1")
    return u.withColumn("_cur", F.when((F.col("_cur.e") > F.col("pos")) & (F.col("_cur.o") < F.col("pos")), F.col("_cur")))


def end_around(spans: DataFrame, is_point: Column, is_owner: Column, out: str) -> DataFrame:
    """``spans(page_id, pos, end, ...)`` that are points, with the end ``out`` of the innermost of the spans that are
    owners around them, or null. Points and owners are rows of one relation, which is read once."""
    cols = [c for c in spans.columns if c != "page_id"]
    pos, end, no_span = F.col("pos").cast("int"), F.col("end").cast("int"), F.lit(None).cast(SPAN)

    def row(at, k, d, ow, full):
        held = F.struct(*cols) if full else F.lit(None).cast(spans.select(F.struct(*cols).alias("s")).schema["s"].dataType)
        return F.struct(at.alias("pos"), F.lit(k).alias("_k"), F.lit(d).alias("_d"), ow.alias("_ow"), held.alias("_row"))

    u = dealt(spans, ["page_id"], F.when(is_point, row(pos, 1, 0, no_span, True)),
              F.when(is_owner, row(pos, 2, 1, F.struct(pos.alias("o"), end.alias("e")), False)),
              F.when(is_owner, row(end, 0, -1, no_span, False))).filter("_k IS NOT NULL")
    return _innermost(u, keep=True).select("page_id", "_row.*", F.col("_cur.e").alias(out))


def outermost(elements: DataFrame) -> DataFrame:
    """The ``elements(page_id, open_pos, end_pos, ...)`` that no other of them contains."""
    before = Window.partitionBy("page_id").orderBy("open_pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end_pos").over(before), F.lit(-1))
    return elements.withColumn("_reach", reach).filter(F.col("_reach") <= F.col("open_pos")).drop("_reach")


def ordered_concat(df: DataFrame, keys: list[str], order: str, value: str, sep: str = "", out: str = "text") -> DataFrame:
    """Concatenate ``value`` per ``keys`` in ``order`` (ties impossible: positions are unique)."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(arr, lambda x: x["v"]), sep).alias(out))
