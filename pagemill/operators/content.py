"""The container that holds most of a page's text, for pages that name no main element.

A text block of at least ``LEAST`` characters scores one, one for each comma and one for each hundred characters up to
three. The container around it takes the score, the next one out half of it; a container's total counts by the share of
its text that is no link text. The best of a page wins, the first on ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_inline_ws, trim_ws
from ..plans.intervals import assign_owner, interval_sums, ordered_concat

BLOCKS = ["p", "pre", "td", "blockquote", "li", "dd"]
CONTAINERS = ["article", "main", "section", "div", "td", "body"]
LEAST = 25


def scored_containers(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """``(page_id, open_pos, end_pos, score)`` of containers with a scored block in or one level below them;
    ``texts(page_id, pos, text)``."""
    spans = lambda *tags: elements.filter(F.col("tag").isin(*tags)).select("page_id", "open_pos", "end_pos")
    block = ordered_concat(assign_owner(texts, spans(*BLOCKS), "b"), ["page_id", "b_open"], "pos", "text")
    text = trim_ws(collapse_inline_ws(F.col("text")))
    block = block.select("page_id", F.col("b_open").alias("pos"), text.alias("text")).filter(F.length("text") >= LEAST)
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    block = block.select("page_id", "pos", (1 + commas + F.least(F.floor(F.length("text") / 100), F.lit(3))).cast("double").alias("s"))
    boxes = spans(*CONTAINERS)
    full = assign_owner(block, boxes, "c").groupBy("page_id", F.col("c_open").alias("open_pos")).agg(F.sum("s").alias("s"))
    half = assign_owner(full.select("page_id", F.col("open_pos").alias("pos"), (F.col("s") / 2).alias("s")), boxes, "c")
    total = full.unionByName(half.select("page_id", F.col("c_open").alias("open_pos"), "s")).groupBy("page_id", "open_pos").agg(F.sum("s").alias("s"))
    linked = assign_owner(texts, spans("a"), "a").select("page_id", "pos", F.lit(True).alias("linked"))
    sized = texts.join(linked, ["page_id", "pos"], "left").select(
        "page_id", "pos", F.length(trim_ws(F.col("text"))).alias("chars"), F.when(F.col("linked"), F.length(trim_ws(F.col("text")))).otherwise(0).alias("link_chars"))
    inside = interval_sums(sized, boxes, ["chars", "link_chars"])
    total = total.join(inside, ["page_id", "open_pos"]).join(boxes, ["page_id", "open_pos"])
    score = F.col("s") * (1 - F.col("link_chars").cast("double") / F.greatest("chars", F.lit(1)))
    return total.select("page_id", "open_pos", "end_pos", score.alias("score"))


def best_container(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """``(page_id, open_pos, end_pos)`` of each page's best container."""
    first = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "open_pos"))
    return scored_containers(elements, texts).withColumn("_rn", first).filter("_rn = 1").select("page_id", "open_pos", "end_pos")
