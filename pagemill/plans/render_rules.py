"""What rendering writes for an element, as a table of rules.

A rule says what stands before and after the content of an element of its tag (and class, if it names one). ``fill`` names
the value of the element that ``{}`` in these texts stands for: ``link`` (target and title), ``id`` (of a heading),
``ticks`` (a delimiter longer than the backticks in a code span; turned round at its end) or ``box`` (the state of a task
box). Without that value a text that has ``{}`` is left out, and the whole rule if it is ``required``.

Of several rules that an element meets, one that names a class comes before one that names none, and a later one before
an earlier one; so rows that a caller adds replace those given here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import same
from ..functions.text import WS
from ..operators.tokens import attr

SCHEMA = "tag string, class_name string, open_md string, close_md string, fill string, required boolean"

# The delimiters of the documents.
BASE_RULES = (
    [(f"h{n}", None, "#" * n + " ", " {#{}}", "id", False) for n in range(1, 7)]
    + [(t, None, "**", "**", None, False) for t in ("b", "strong")]
    + [(t, None, "_", "_", None, False) for t in ("i", "em")]
    + [("code", None, "{}", "{}", "ticks", True), ("a", None, "[", "]({})", "link", True),
       ("br", None, "  \n", None, None, False), ("hr", None, "* * *", None, None, False)]
)
# What the gfm option adds, beside tables.
GFM_RULES = (
    [(t, None, "~~", "~~", None, False) for t in ("del", "s", "strike")]
    + [("input", None, "[{}] ", None, "box", True)]
)


def render_rules(spark: SparkSession, gfm: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """``(tag, rules)``: each tag's rules, the one to try first in front. ``extra`` has the columns of ``SCHEMA``."""
    rows = [(*r, i) for i, r in enumerate(BASE_RULES + (GFM_RULES if gfm else []))]
    given = spark.createDataFrame(rows, SCHEMA + ", nth int")
    if extra is not None:
        later = extra.select(*[F.col(c.split()[0]) for c in SCHEMA.split(", ")], F.lit(len(rows)).alias("nth"))
        given = given.unionByName(later)
    order = F.struct(F.col("class_name").isNull().alias("any"), (-F.col("nth")).alias("nth"), "class_name", "open_md",
                     "close_md", "fill", "required")
    return given.coalesce(1).groupBy("tag").agg(F.array_sort(F.collect_list(order)).alias("rules"))


def written(elements: DataFrame, rules: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``elements(page_id, tag, attrs, …)`` with ``open_md`` and ``close_md`` by their first rule, null where it says nothing.

    The rules are broadcast: they are as many as the caller writes down, whatever the number of pages.
    """
    r = rules.select(F.col("tag").alias("_tag"), "rules")
    e = elements.join(F.broadcast(r), same((elements["tag"], r["_tag"])), "left").drop("_tag")
    classes = F.split(F.coalesce(attr("attrs", "class"), F.lit("")), f"[{WS}]+")
    mine = F.filter("rules", lambda r: r["class_name"].isNull() | F.array_contains(classes, r["class_name"]))
    e = e.withColumn("rule", F.try_element_at(mine, F.lit(1))).drop("rules")
    value = F.lit(None).cast("string")
    for name, v in values.items():
        value = F.when(F.col("rule.fill") == name, v).otherwise(value)
    e = e.withColumn("value", value)

    def text(field: str, v: Column) -> Column:
        t = F.col(f"rule.{field}")
        usable = ~F.coalesce(F.col("rule.required"), F.lit(False)) | v.isNotNull()
        return F.when(usable & t.contains("{}"), F.replace(t, F.lit("{}"), v)).when(usable, t)

    end = F.when(F.col("rule.fill") == "ticks", F.reverse("value")).otherwise(F.col("value"))
    return e.withColumns({"open_md": text("open_md", F.col("value")), "close_md": text("close_md", end)}).drop("rule", "value")
