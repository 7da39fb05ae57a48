"""Footnotes.

References (U3): phase 1 is every ``sup`` with an ``a[href]`` inside (its first
such anchor), phase 2 every anchor marked as a note reference
(``role=doc-noteref``, ``data-footnote-ref``, class ``footnote-ref`` or
``fnref``) not already used in phase 1. The target id is the link's fragment
(F12); references without one are ignored.

Labels (W2) are assigned per target in order of first reference: the
anchor's text without brackets (F13), or, when blank or already taken, the
smallest unused number greater than the count of labels so far. That rule is
sequential, so each page's ordered list of targets is folded with
``aggregate``, which carries the last number dealt out; pages are independent.

Definitions (J2) are the first element whose id is the target; back-links
inside them are dropped (P11); the content, as Markdown in one line, becomes the note. Definitions leave
the body, and a list emptied by that leaves with them (P13). The appendix
(A3) lists ``[^label]: text`` in label order of first reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators.tokens import attr, has_class
from ..plans.intervals import assign_owner, ordered_concat
from .inline import inline_markdown

NOTE_REF_CLASSES = ["footnote-ref", "fnref"]


def _anchors(conv) -> DataFrame:
    e = conv.kept_elements
    a = e.filter((F.col("tag") == "a") & attr("attrs", "href").isNotNull())
    noteref = ((attr("attrs", "role") == "doc-noteref") | attr("attrs", "data-footnote-ref").isNotNull()
               | has_class("attrs", "footnote-ref") | has_class("attrs", "fnref"))
    return a.select("page_id", F.col("open_pos").alias("pos"), "end_pos", "stop_pos",
                    attr("attrs", "href").alias("href"), noteref.alias("noteref"))


def references(conv) -> DataFrame:
    """``(page_id, phase, ref_pos, stop_pos, anchor_pos, target, raw_label)``."""
    e = conv.kept_elements
    toks = conv.cleaned_tokens
    a = _anchors(conv).join(conv.corpus.page_info.select("page_id", "url"), "page_id")
    a = conv.written_out(a.withColumn("target", U.target_id(F.col("href"), F.col("url"))))
    sup = e.filter(F.col("tag") == "sup").select("page_id", "open_pos", "end_pos", "stop_pos")
    owned = assign_owner(a.select("page_id", "pos"), sup.select("page_id", "open_pos", "end_pos"), "s")
    first = owned.groupBy("page_id", "s_open").agg(F.min("pos").alias("pos"))
    r1 = first.join(a, ["page_id", "pos"]).join(sup.select("page_id", F.col("open_pos").alias("s_open"),
                                                           F.col("stop_pos").alias("s_stop")), ["page_id", "s_open"])
    r1 = r1.filter(F.col("target") != "").select(
        "page_id", F.lit(1).alias("phase"), F.col("s_open").alias("ref_pos"), F.col("s_stop").alias("stop_pos"),
        F.col("pos").alias("anchor_pos"), "target")
    used = r1.select("page_id", F.col("anchor_pos").alias("pos"))
    r2 = a.filter(F.col("noteref") & (F.col("target") != "")).join(used, ["page_id", "pos"], "left_anti").select(
        "page_id", F.lit(2).alias("phase"), F.col("pos").alias("ref_pos"), "stop_pos",
        F.col("pos").alias("anchor_pos"), "target")
    refs = r1.unionByName(r2)
    anchors = a.select("page_id", F.col("pos").alias("open_pos"), "end_pos")
    txt = toks.filter(F.col("kind") == "text").select("page_id", "pos", "text")
    at = ordered_concat(assign_owner(txt, anchors, "a"), ["page_id", "a_open"], "pos", "text")
    refs = refs.join(at.select("page_id", F.col("a_open").alias("anchor_pos"), "text"), ["page_id", "anchor_pos"], "left")
    return refs.withColumn("raw_label", X.footnote_label(F.coalesce("text", F.lit("")))).drop("text")


def labels(refs: DataFrame) -> DataFrame:
    """``(page_id, target, ord, label)`` by first reference, clash-aware."""
    first = refs.withColumn("_rn", F.row_number().over(
        Window.partitionBy("page_id", "target").orderBy("phase", "ref_pos"))).filter("_rn = 1")
    arr = F.array_sort(F.collect_list(F.struct("phase", "ref_pos", "target", "raw_label")))
    per_page = first.groupBy("page_id").agg(arr.alias("items"))
    state = "struct<used:array<string>,given:array<int>,last:int,out:array<struct<target:string,label:string>>>"
    init = F.struct(F.array().alias("used"), F.array().alias("given"), F.lit(0).alias("last"), F.array().alias("out")).cast(state)

    def step(acc, x):
        # numbers are dealt out in rising order; of those from ``low`` on, only labels that pages gave are taken
        low = F.greatest(F.size(acc["used"]) + 1, acc["last"] + 1)
        above = F.size(F.filter(acc["given"], lambda n: n >= low))
        free = F.element_at(F.array_except(F.sequence(low, low + above), acc["given"]), 1)
        own = (x["raw_label"] != "") & ~F.array_contains(acc["used"], x["raw_label"])
        lab = F.when(own, x["raw_label"]).otherwise(free.cast("string"))
        number = x["raw_label"].try_cast("int")
        is_number = F.coalesce(own & (number.cast("string") == x["raw_label"]), F.lit(False))
        return F.struct(F.concat(acc["used"], F.array(lab)).alias("used"),
                        F.when(is_number, F.concat(acc["given"], F.array(number))).otherwise(acc["given"]).alias("given"),
                        F.when(own, acc["last"]).otherwise(free).alias("last"),
                        F.concat(acc["out"], F.array(F.struct(x["target"].alias("target"), lab.alias("label")))).alias("out")).cast(state)

    folded = per_page.select("page_id", F.aggregate("items", init, step)["out"].alias("out"))
    return folded.select("page_id", F.posexplode("out").alias("ord", "o")).select(
        "page_id", F.col("o.target").alias("target"), (F.col("ord") + 1).cast("long").alias("ord"),
        F.col("o.label").alias("label"))


def definitions(conv, labs: DataFrame) -> DataFrame:
    """J2 + P11: ``(page_id, target, open_pos, stop_pos, note)`` for labelled targets."""
    e = conv.kept_elements
    d = e.filter(F.col("id").isNotNull()).select("page_id", F.col("id").alias("target"), "open_pos", "end_pos", "stop_pos")
    d = d.join(labs.select("page_id", "target"), ["page_id", "target"], "left_semi")
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy("page_id", "target").orderBy("open_pos"))) \
        .filter("_rn = 1").drop("_rn")
    d = conv.written_out(d)
    back = conv.written_out(e.filter(((F.col("tag") == "a") & ((attr("attrs", "role") == "doc-backlink")
                                               | F.coalesce(attr("attrs", "href"), F.lit("")).startswith("#fnref")
                                               | F.coalesce(attr("attrs", "href"), F.lit("")).startswith("#ref")))
                    | has_class("attrs", "footnote-backref")).select("page_id", "open_pos", "stop_pos"))
    replaced = back.withColumn("md", F.lit("")).unionByName(conv.inline_images.join(back.select("page_id", "open_pos"), ["page_id", "open_pos"], "left_anti"))
    dt = inline_markdown(conv, d.select("page_id", "open_pos", "end_pos"), replaced)
    d = d.join(dt.withColumnRenamed("c_open", "open_pos"), ["page_id", "open_pos"], "left")
    note = X.escape_line_starts(F.coalesce("md", F.lit("")), F.lit(True))
    return d.select("page_id", "target", "open_pos", "stop_pos", note.alias("note"))


def emptied_lists(conv, defs: DataFrame) -> DataFrame:
    """``ol``/``ul`` whose element children are all removed definitions."""
    from .extract import parent_of
    e = conv.kept_elements
    par = parent_of(e.select("page_id", "open_pos", "stop_pos"))
    kids = par.join(defs.select("page_id", "open_pos").withColumn("is_def", F.lit(1)), ["page_id", "open_pos"], "left")
    cnt = kids.groupBy("page_id", "parent_open").agg(F.count("*").alias("n"), F.sum(F.coalesce("is_def", F.lit(0))).alias("d"))
    lists = e.filter(F.col("tag").isin("ol", "ul")).select("page_id", F.col("open_pos").alias("parent_open"), "stop_pos")
    return lists.join(cnt.filter(F.col("n") == F.col("d")), ["page_id", "parent_open"]).select(
        "page_id", F.col("parent_open").alias("open_pos"), "stop_pos")


def appendix(labs: DataFrame, defs: DataFrame) -> DataFrame:
    """A3: ``(page_id, appendix)`` for pages with at least one non-empty note."""
    j = labs.join(defs.select("page_id", "target", "note"), ["page_id", "target"]).filter(F.col("note") != "")
    line = F.concat(F.lit("[^"), F.col("label"), F.lit("]: "), F.replace(F.col("note"), F.lit("\n"), F.lit("\n    ")))
    return ordered_concat(j.withColumn("line", line), ["page_id"], "ord", "line", "\n", "appendix")


def note_replacements(conv) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Render pieces: ``(refs md '[^label]', definitions '', emptied lists '', appendix)``.

    Each step is written before the next ones read it: all of them go back to the references, which took a pass over the
    page's texts for each place that reads one.
    """
    refs = conv.written_out(references(conv))
    labs = conv.written_out(labels(refs))
    defs = conv.written_out(definitions(conv, labs))
    r = refs.join(labs.select("page_id", "target", "label"), ["page_id", "target"]).select(
        "page_id", F.col("ref_pos").alias("open_pos"), "stop_pos", F.concat(F.lit("[^"), F.col("label"), F.lit("]")).alias("md"))
    dm = defs.select("page_id", "open_pos", "stop_pos", F.lit("").alias("md"))
    lm = emptied_lists(conv, defs).select("page_id", "open_pos", "stop_pos", F.lit("").alias("md"))
    return conv.written_out(r), dm, conv.written_out(lm), appendix(labs, defs)
