"""Allow-lists of tags, attributes and link schemes.

An element outside the tag list goes and its content stays, except that some tags go with all they
hold. Of an allowed element only allowed attributes stay, and of those that hold a link only links of
an allowed scheme (``data:`` for the sources of media).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import SAFE_SCHEMES, link_scheme
from ..plans.intervals import sweep_keep
from .tokens import BLOCK_TAGS, INLINE_TAGS

# Fixed values [ours]: tags beside the block and inline ones, tags that go with their content, attributes.
MORE_TAGS = ["audio", "area", "bdi", "bdo", "br", "button", "center", "col", "colgroup", "data", "datalist", "dfn", "img", "input",
             "legend", "map", "meter", "optgroup", "option", "output", "picture", "progress", "rp", "rt", "ruby", "select", "source",
             "summary", "svg", "textarea", "time", "track", "video", "wbr"]
DROPPED_WITH_CONTENT = ["script", "style", "noscript", "template", "object", "applet", "noembed", "noframes", "frameset", "xmp"]
ATTRIBUTES = ["abbr", "align", "alt", "cite", "class", "cols", "colspan", "controls", "datetime", "dir", "disabled", "height",
              "hidden", "href", "hreflang", "id", "kind", "label", "lang", "loop", "media", "muted", "name", "open", "poster", "rel",
              "reversed", "role", "rows", "rowspan", "scope", "sizes", "span", "src", "srcset", "start", "style", "summary",
              "tabindex", "title", "translate", "type", "valign", "value", "width"]
LINK_ATTRIBUTES = ["href", "src", "poster", "cite"]
DATA_TAGS = ["img", "audio", "video", "source", "track"]


def allowed_tag(tag: Column) -> Column:
    return tag.isin(*BLOCK_TAGS, *INLINE_TAGS, *MORE_TAGS)


def allowed_attribute(tag: Column, name: Column, value: Column) -> Column:
    named = name.isin(*ATTRIBUTES) | name.startswith("data-") | name.startswith("aria-")
    scheme = link_scheme(value)
    safe = (scheme == "") | scheme.isin(*SAFE_SCHEMES) | ((scheme == "data") & tag.isin(*DATA_TAGS))
    return named & (~name.isin(*LINK_ATTRIBUTES) | safe)


def sanitize(elements: DataFrame) -> DataFrame:
    """Allowed elements with their allowed attributes: ``(page_id, open_pos, tag, attrs)``."""
    dropped = elements.filter(F.col("tag").isin(*DROPPED_WITH_CONTENT)).select("page_id", "open_pos", "stop_pos")
    kept = elements.filter(allowed_tag(F.col("tag"))).select("page_id", F.col("open_pos").alias("pos"), "tag", "attrs")
    attrs = F.map_filter("attrs", lambda k, v: allowed_attribute(F.col("tag"), k, v))
    return sweep_keep(kept, dropped).select("page_id", F.col("pos").alias("open_pos"), "tag", attrs.alias("attrs"))
