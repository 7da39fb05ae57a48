"""Noise removal on the token relation.

All removals become half-open intervals ``[open_pos, stop_pos)`` of elements
and are applied with the linear sweep of ``plans.intervals.sweep_keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, int_prefix
from ..operators import select as S
from ..operators.tokens import attr
from ..plans.intervals import interval_sums, sweep_keep

# Tags exempt from the hidden/empty checks (media), and tags
# counted as media content when deciding emptiness.
MEDIA_TAGS = ["img", "video", "audio", "picture", "source"]
MEDIA_CONTENT_TAGS = ["img", "video", "audio"]
# [ours] void tags and table cells are never removed as "empty" (keeps line
# breaks, rules and table shape).
EMPTY_EXEMPT = ["br", "hr", "wbr", "td", "th", "col", "input"]
# Embedded media and SVGs are replaced by descriptions before cleaning: they
# are neither hidden nor empty, and they count as content of their ancestors.
REPLACED_TAGS = ["iframe", "video", "audio", "svg"]


def removal_intervals(els: DataFrame, matched: DataFrame) -> DataFrame:
    return els.join(matched.select("page_id", "open_pos").distinct(), ["page_id", "open_pos"]).select(
        "page_id", "open_pos", "stop_pos")


def remove_selectors(tokens: DataFrame, els: DataFrame, rules: DataFrame, by_host: bool = False) -> DataFrame:
    """P1 (defaults, scope '*') / P2 (per-site, scope = host): drop matched subtrees."""
    return remove_selector_sets(tokens, els, [(rules, by_host)])


def remove_selector_sets(tokens: DataFrame, els: DataFrame, rule_sets) -> DataFrame:
    """P1 + P2 in one sweep: the union of all matched subtrees is removed at once.

    Removing subtrees is order-independent (a node inside an already removed
    subtree is gone either way), so the default and per-site selector lists
    share one match over the element facts and one sweep over the tokens.
    Embedded media and SVGs are described before cleaning, so they are no
    targets themselves; they go with the subtrees they are in.
    """
    f = S.facts(els.filter(~F.col("tag").isin(*REPLACED_TAGS)))
    matched = None
    for rules, by_host in rule_sets:
        m = S.match(f, S.conditions(rules), by_host=by_host).select("page_id", "open_pos")
        matched = m if matched is None else matched.unionByName(m)
    return sweep_keep(tokens, removal_intervals(els, matched))


def is_hidden(attrs_col: str = "attrs"):
    """``hidden``, ``aria-hidden="true"``, inline ``display:none`` / ``visibility:hidden``."""
    style = F.lower(F.coalesce(attr(attrs_col, "style"), F.lit("")))
    return (
        attr(attrs_col, "hidden").isNotNull()
        | (attr(attrs_col, "aria-hidden") == "true")
        | style.rlike(r"(^|;)\s*display\s*:\s*none\s*(!important\s*)?(;|$)")
        | style.rlike(r"(^|;)\s*visibility\s*:\s*hidden\s*(!important\s*)?(;|$)")
    )


def hidden_and_empty(tokens: DataFrame, els: DataFrame, extra_intervals: DataFrame | None = None) -> DataFrame:
    """P4 + P5 (+ any ``extra_intervals``, e.g. P6 tiny images) in one sweep
    over the tokens left by P1/P2.

    Emptiness is judged on those tokens (hidden children and tiny images still
    count), as in the single document-order pass it re-states. Media tags are
    exempt.
    """
    kept_open = tokens.filter(F.col("kind").isin("open", "void", "raw")).select("page_id", F.col("pos").alias("open_pos"))
    live = els.join(kept_open, ["page_id", "open_pos"], "left_semi")
    live = live.filter(~F.col("tag").isin(*MEDIA_TAGS) & ~F.col("tag").isin(*REPLACED_TAGS))
    pts = tokens.select(
        "page_id", "pos",
        F.when((F.col("kind") == "text") & F.col("text").rlike(f"[^{WS}]"), 1).otherwise(0).alias("w_text"),
        F.when(F.col("kind").isin("open", "void") & F.col("tag").isin(*MEDIA_CONTENT_TAGS), 1).otherwise(0).alias("w_media"),
        F.when(F.col("kind").isin("open", "void") & F.col("tag").isin(*REPLACED_TAGS), 1).otherwise(0).alias("w_repl"),
    )
    pts = pts.filter("w_text + w_media + w_repl > 0")
    # an icon is removed before emptiness is judged: neither it nor its title is content
    icons = els.filter((F.col("tag") == "svg") & icon_svg()).select("page_id", "open_pos", "stop_pos")
    pts = sweep_keep(pts, icons)
    inside = interval_sums(pts, live.select("page_id", "open_pos", "end_pos"), ["w_text", "w_media", "w_repl"])
    cand = live.join(inside, ["page_id", "open_pos"], "left")
    empty = ((F.coalesce("w_text", F.lit(0)) + F.coalesce("w_media", F.lit(0)) + F.coalesce("w_repl", F.lit(0))) == 0) \
        & ~F.col("tag").isin(*EMPTY_EXEMPT) & (F.col("ekind") != "raw")
    drop = cand.filter(is_hidden() | empty).select("page_id", "open_pos", "stop_pos")
    if extra_intervals is not None:
        drop = drop.unionByName(extra_intervals.select("page_id", "open_pos", "stop_pos"))
    return sweep_keep(tokens, drop)


def tiny_image(attrs_col: str = "attrs"):
    """``0 < width < 32 and 0 < height < 32``."""
    w = int_prefix(attr(attrs_col, "width"))
    h = int_prefix(attr(attrs_col, "height"))
    return (w > 0) & (w < 32) & (h > 0) & (h < 32)


def icon_svg(attrs_col: str = "attrs"):
    """``0 < width < 48 and 0 < height < 48``."""
    w = int_prefix(attr(attrs_col, "width"))
    h = int_prefix(attr(attrs_col, "height"))
    return (w > 0) & (w < 48) & (h > 0) & (h < 48)
