"""Markdown of an element's content in one line: what a table cell or a note holds (R1 within E11, R6, E9, A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.intervals import assign_owner, dealt, ordered_concat, sweep_keep
from .tokens import BLOCK_TAGS

BREAKS = [*BLOCK_TAGS, "br"]


def inline_markdown(conv, containers: DataFrame, replaced: DataFrame) -> DataFrame:
    """``(page_id, c_open, md)`` of the ``containers(page_id, open_pos, end_pos)`` that hold anything.

    Inline elements are written by the conversion's rendering rules, ``replaced(page_id, open_pos, stop_pos, md)`` are taken
    over as given, a block inside is set off by a space. Where containers nest, a token counts for the innermost.
    """
    containers, replaced = conv.written_out(containers), conv.written_out(replaced)  # read twice
    toks = sweep_keep(conv.cleaned_tokens.select("page_id", "pos", "kind", "tag", "text"), replaced)
    inside = conv.written_out(assign_owner(toks, containers, "c"))
    so_far = Window.partitionBy("page_id", "c_open").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    code = F.when(F.col("tag") == "code", F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1))
    flat = X.collapse_inline_ws("text")
    said = (F.when(F.col("kind") == "text", F.when(F.col("in_code") > 0, flat).otherwise(X.escape_markdown_text(flat)))
            .when(F.col("kind").isin("open", "close", "void") & F.col("tag").isin(*BREAKS), F.lit(" ")))

    def piece(k1, k2: int, k3, md):
        return F.struct(k1.cast("int").alias("k1"), F.lit(k2).alias("k2"), k3.cast("int").alias("k3")).alias("k"), md.alias("md")

    texts = inside.withColumn("in_code", F.sum(F.coalesce(code, F.lit(0))).over(so_far)).select(
        "page_id", "c_open", *piece(F.col("pos"), 1, F.lit(0), said))
    opens = inside.filter(F.col("kind").isin("open", "void") & ~F.col("tag").isin(*BREAKS)).select(
        "page_id", F.col("pos").alias("open_pos"), "c_open")
    e = conv.element_texts(conv.kept_elements.join(opens, ["page_id", "open_pos"]).withColumns(
        {c: F.lit(None).cast("string") for c in ("hid", "unwrap", "box")}))
    marks = dealt(  # begins and ends of one relation, which is read once
        e, ["page_id", "c_open"], F.struct(*piece(F.col("open_pos"), 1, F.lit(1), F.col("open_md"))),
        F.struct(*piece(F.col("end_pos"), 0, -F.col("open_pos"), F.when(F.col("ekind") == "open", F.col("close_md")))))
    given = assign_owner(replaced.select("page_id", F.col("open_pos").alias("pos"), "md"), containers, "c").select(
        "page_id", "c_open", *piece(F.col("pos"), 1, F.lit(0), F.col("md")))
    pieces = texts.unionByName(marks).unionByName(given).filter(F.col("md").isNotNull())
    line = ordered_concat(conv.written_out(pieces), ["page_id", "c_open"], "k", "md", "", "md")
    return line.select("page_id", "c_open", X.trim_ws(X.collapse_inline_ws("md")).alias("md"))
