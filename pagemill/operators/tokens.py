"""Pages -> tokens -> elements (+ attributes).

The DOM of a page is represented relationally:

* ``tokens(page_id, pos, kind, tag, tok)`` - document-order lexical tokens, made by one
  ``regexp_extract_all`` + ``posexplode`` per page (no shuffle: a page's tokens stay in the
  partition that holds the page row). What a raw-text element (``RAW_TEXT_TAGS``) holds is one text token.
* ``elements(page_id, tag, open_pos, end_pos, stop_pos, explicit, tok)`` - an element owns the tokens
  ``open_pos <= pos < stop_pos``; its content is ``open_pos < pos < end_pos``.

Open and close tags are paired with window functions only: running depth per tag, then ``lead`` within
a depth. A pair that would end after the structural element it begins in is none: its end tag belongs to an
element further out, so such opens are left out and the others paired again. What has no end tag ends where its
kind implies it, at the latest with the innermost structural element around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, decode_entities

# Token pattern. Comments, whole script/style elements, tags
# (quoted attribute values may contain '>'; the possessive '*+' keeps Java's
# regex engine from deep backtracking), text runs, and a lone '<'.
RAW_TEXT_TAGS = ["textarea", "title", "iframe", "xmp", "noembed"]
RAW_TEXT_OPEN = r"""(?:\s(?:[^>"'/]|"[^"]*"|'[^']*'|/[^>])*+)?>"""
RAW_TEXT_PATTERN = "|".join(rf"<{t}{RAW_TEXT_OPEN}.*?</{t}\s*>" for t in RAW_TEXT_TAGS)
TAG_PATTERN = (
    r"""(?is)<!--.*?-->|""" + RAW_TEXT_PATTERN + r"""|<script\b.*?</script\s*>|<style\b.*?</style\s*>"""
    r"""|</?[a-z!](?:[^>"']|"[^"]*"|'[^']*')*+>"""
)
TOKEN_PATTERN = TAG_PATTERN + r"|[^<]+|<"

# HTML tag classes.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr"]
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "body", "caption", "dd", "details",
              "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
              "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
              "menu", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th",
              "thead", "tr", "ul"]
INLINE_TAGS = ["a", "abbr", "b", "big", "cite", "code", "del", "em", "font", "i", "ins", "kbd",
               "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub",
               "sup", "tt", "u", "var"]
# Elements that bound what is left open in them: a paragraph or formatting doesn't.
BOUND_TAGS = [t for t in BLOCK_TAGS if t not in ("p", "hr", "html", "body")]
# Tags whose end may be implied, and which tokens imply it:
#   p and inline formatting -> next block open/close
#   li -> next li open or list close;  dt/dd -> next dt/dd open or dl close
#   tr -> next tr / table-section open or table(-section) close
#   td/th -> next cell / row / section open or row / section / table close
#   thead/tbody/tfoot -> next section open or table close
#   option -> next option/optgroup open or select/datalist/optgroup close
IMPLIED_END_TAGS = ["p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option"] + INLINE_TAGS

ATTR_PATTERN = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""


def tokenize(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html, ...)`` -> ``tokens(page_id, pos, kind, tag, tok)``."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN_PATTERN), 0)
    whole = rf"(?is)^(<(?:{'|'.join(RAW_TEXT_TAGS)}){RAW_TEXT_OPEN})(.*)(</[a-z]+\s*>)$"

    def parts(m):
        """A raw-text element is three tokens, the middle one text whatever it looks like."""
        item = lambda tok, raw: F.struct(tok.alias("tok"), F.lit(raw).alias("raw"))
        piece = lambda k: F.regexp_extract(m, whole, k)
        split = F.filter(F.array(item(piece(1), False), item(piece(2), True), item(piece(3), False)), lambda x: x["tok"] != "")
        return F.when(F.rlike(m, F.lit(whole)), split).otherwise(F.array(item(m, False)))

    toks = pages.select("page_id", F.posexplode(F.flatten(F.transform(found, parts))).alias("pos", "t")).select("page_id", "pos", "t.*")
    head = F.lower(F.substring("tok", 1, 9))
    name = F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    kind = (
        F.when(F.col("raw"), F.lit("text"))
        .when(F.col("tok").startswith("<!--"), F.lit("comment"))
        .when(F.col("tok").startswith("<!"), F.lit("doctype"))
        .when((head.startswith("<script") | head.startswith("<style")) & F.lower("tok").rlike(r"</(script|style)\s*>$"),
              F.lit("raw"))
        .when(F.col("tok").startswith("</") & (name != ""), F.lit("close"))
        .when(F.col("tok").rlike(r"^<[A-Za-z]"),
              F.when(name.isin(*VOID_TAGS) | F.col("tok").endswith("/>"), F.lit("void")).otherwise(F.lit("open")))
        .otherwise(F.lit("text"))
    )
    return toks.select(
        "page_id", "pos", kind.alias("kind"),
        F.when(name != "", name).alias("tag"), "tok",
    ).select("page_id", "pos", "kind", F.when(F.col("kind").isin("open", "close", "void", "raw"), F.col("tag")).alias("tag"), "tok")


def tags_named(html: Column, *names: str) -> Column:
    """The void, open and whole raw-text tags of these names in page order, of the page's row: what the tokens would hold."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG_PATTERN), 0)
    return F.filter(found, lambda t: F.rlike(t, F.lit(rf"(?i)^<(?:{'|'.join(names)})(?![a-z0-9:-])")))


def text_of(tok: Column) -> Column:
    """Decoded character data of a text token."""
    return decode_entities(tok)


def _flag(cond: Column) -> Column:
    return F.when(cond, F.col("pos"))


def _paired(tags: DataFrame) -> DataFrame:
    """Tag tokens with the kind and place of the next one of their tag and depth: an open's end tag, if it is a close."""
    by_tag = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    t = tags.withColumn("rs", F.sum(delta).over(by_tag))
    t = t.withColumn("lvl", F.when(F.col("kind") == "close", F.col("rs") + 1).otherwise(F.col("rs")))
    by_lvl = Window.partitionBy("page_id", "tag", "lvl").orderBy("pos")
    return t.withColumn("nxt_kind", F.lead("kind").over(by_lvl)).withColumn("nxt_pos", F.lead("pos").over(by_lvl))


def _bounds() -> Column:
    """Of paired tags the opens of structural elements with an end tag."""
    return (F.col("kind") == "open") & (F.col("nxt_kind") == "close") & F.col("tag").isin(*BOUND_TAGS)


def elements(tokens: DataFrame) -> DataFrame:
    """S3: pair tags into elements with explicit or implied ends.

    Each pairing is read once: what is inside and what is around comes from the same rows. The tokens' text joins at the end.
    """
    from ..plans.intervals import end_around

    with_text = tokens.filter(F.col("kind").isin("open", "close", "void", "raw")).select("page_id", "pos", "kind", "tag", "tok")
    tags = with_text.select("page_id", "pos", "kind", "tag")
    # first pairing: what ends outside the structural element it begins in has no end tag of its own
    closed = _paired(tags.filter(F.col("tag").isin(*BOUND_TAGS))).filter(_bounds()).select("page_id", "pos", F.col("nxt_pos").alias("end"))
    crossing = end_around(closed, F.lit(True), F.lit(True), "around_end").filter("around_end < end")
    tags = tags.join(crossing.select("page_id", "pos", F.lit("unclosed").alias("other")), ["page_id", "pos"], "left")
    tags = tags.withColumn("kind", F.coalesce("other", "kind")).drop("other")
    t = _paired(tags)
    t = t.withColumn("kind", F.when(F.col("kind") == "unclosed", "open").otherwise(F.col("kind")))
    t = t.withColumn("nxt_kind", F.when(F.col("nxt_kind") == "unclosed", "open").otherwise(F.col("nxt_kind")))

    # Boundaries that end an element whose close tag is missing: the nearest
    # following token of each class (a running min over reversed order, so the
    # frame grows incrementally instead of being recomputed per row).
    k, g = F.col("kind"), F.col("tag")
    o = lambda *tags: (k == "open") & g.isin(*tags)
    c = lambda *tags: (k == "close") & g.isin(*tags)
    block_any = (k.isin("open", "close", "void")) & g.isin(*BLOCK_TAGS)
    rev = Window.partitionBy("page_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    classes = {
        "b_block": block_any,
        "b_li": o("li") | c("ul", "ol", "menu"),
        "b_dl": o("dt", "dd") | c("dl"),
        "b_tr": o("tr", "thead", "tbody", "tfoot") | c("table", "thead", "tbody", "tfoot"),
        "b_cell": o("td", "th", "tr", "thead", "tbody", "tfoot") | c("tr", "table", "thead", "tbody", "tfoot"),
        "b_tsec": o("thead", "tbody", "tfoot") | c("table"),
        "b_opt": o("option", "optgroup") | c("select", "datalist", "optgroup"),
    }
    opens = t.select("*", *[F.min(_flag(cond)).over(rev).alias(name) for name, cond in classes.items()])
    opens = opens.filter(F.col("kind").isin("open", "void", "raw"))
    implied = (
        F.when(g == "p", F.col("b_block"))
        .when(g == "li", F.col("b_li"))
        .when(g.isin("dt", "dd"), F.col("b_dl"))
        .when(g == "tr", F.col("b_tr"))
        .when(g.isin("td", "th"), F.col("b_cell"))
        .when(g.isin("thead", "tbody", "tfoot"), F.col("b_tsec"))
        .when(g == "option", F.col("b_opt"))
        .when(g.isin(*INLINE_TAGS), F.col("b_block"))
    )
    # what is sorted from here on is narrow: an element's own end, the end implied and whether it bounds others
    opens = opens.select("page_id", "pos", "kind", "tag", F.when(F.col("nxt_kind") == "close", F.col("nxt_pos")).alias("end"),
                         implied.alias("implied"), _bounds().alias("bound"))
    opens = end_around(opens, F.lit(True), F.col("bound"), "around_end")
    own_end, implied = F.col("end"), F.col("implied")
    explicit = (k != "open") | F.coalesce(own_end <= F.coalesce("around_end", own_end), F.lit(False))
    end_pos = (
        F.when(k != "open", F.col("pos"))
        .when(explicit, own_end)
        .otherwise(F.least(F.coalesce(implied, F.lit(1 << 30)), F.coalesce("around_end", F.lit(1 << 30))))
    )
    out = opens.select(
        "page_id", "tag", F.col("pos").alias("open_pos"), end_pos.alias("end_pos"),
        explicit.alias("explicit"), F.col("kind").alias("ekind"),
    )
    texts = with_text.filter(F.col("kind") != "close").select("page_id", F.col("pos").alias("open_pos"), "tok")
    out = out.join(texts, ["page_id", "open_pos"]).select("page_id", "tag", "open_pos", "end_pos", "explicit", "tok", "ekind")
    return out.withColumn(
        "stop_pos", F.when(F.col("explicit"), F.col("end_pos") + 1).otherwise(F.col("end_pos"))
    )


def attributes(elements_df: DataFrame) -> DataFrame:
    """Attach ``attrs: map<name, value>`` parsed from the open tag.

    Names are lower-cased, values entity-decoded, unquoted; a bare attribute
    has value ''. Duplicates keep the first occurrence (HTML rule).
    """
    return elements_df.withColumn("attrs", parse_attrs(F.col("tok")))


def parse_attrs(tok: Column) -> Column:
    body = F.regexp_replace(tok, r"(?s)^<[A-Za-z][^\s/>]*|/?>$", "")
    raw = F.regexp_extract_all(body, F.lit(ATTR_PATTERN), 0)

    def to_pair(m):
        name = F.lower(F.regexp_extract(m, r"^([^\s\"'>/=]+)", 1))
        v = F.regexp_extract(m, r"(?s)^[^\s\"'>/=]+\s*=\s*(.*)$", 1)
        unq = (
            F.when(v.startswith('"'), F.regexp_extract(v, r'(?s)^"(.*)"$', 1))
            .when(v.startswith("'"), F.regexp_extract(v, r"(?s)^'(.*)'$", 1))
            .otherwise(v)
        )
        return F.struct(name.alias("name"), decode_entities(unq).alias("value"))

    pairs = F.transform(raw, to_pair)
    # HTML keeps the first of duplicated attributes: build the map from the
    # reversed list under the LAST_WIN key policy (set in session.configure).
    return F.map_from_entries(F.reverse(pairs))


def attr(attrs: Column | str, name: str) -> Column:
    """``getAttribute(name)``: value, or NULL when absent."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.try_element_at(a, F.lit(name))


def has_class(attrs: Column | str, cls: str) -> Column:
    cl = F.coalesce(attr(attrs, "class"), F.lit(""))
    return F.array_contains(F.split(cl, f"[{WS}]+"), cls)
