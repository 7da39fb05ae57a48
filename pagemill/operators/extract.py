"""Extraction relations (images, media, SVGs, code blocks, tables).

Every relation is built from the element/token relations of a ``Conversion``
with page-local joins and windows: containment (an image inside a
``picture``, a ``source`` inside a ``video``, a ``code`` inside a ``pre``)
is resolved with ``assign_owner`` (a running ``last`` over the page), the
parent of an element with ``parent_of`` (nesting depth + ``last`` per depth),
never with a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators.clean import icon_svg
from ..operators.tokens import attr, has_class
from ..plans.intervals import RUN, assign_owner, dealt, ordered_concat, outermost, sweep_keep
from ..plans.materialize import materialize
from .inline import inline_markdown

# Attribute orders of the lazy-image, srcset, media-source and
# media-title lookups.
LAZY_SRC_ATTRS = ["data-src", "data-original", "data-lazy-src", "data-src-large", "data-image-src"]
SRCSET_ATTRS = ["data-srcset", "data-lazy-srcset", "data-original-srcset", "srcset"]
MEDIA_SRC_ATTRS = ["src", "data-src", "data-url"]
MEDIA_TITLE_ATTRS = ["title", "aria-label", "data-title"]
CLASS_LANGUAGE_RE = r"(?i)^(?:language|lang|code-language|highlight)-(.+)"


def _truthy(c):
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def _first_truthy(*cols):
    return F.coalesce(*[_truthy(c) for c in cols])


def element_text(elements: DataFrame, tokens: DataFrame, prefix: str) -> DataFrame:
    """Text of ``elements(page_id, open_pos, end_pos)`` -> ``(page_id, {prefix}_open, text)``; where elements
    nest, a text counts for the innermost."""
    txt = tokens.filter(F.col("kind") == "text").select("page_id", "pos", "text")
    owned = assign_owner(txt, elements.select("page_id", "open_pos", "end_pos"), prefix)
    return ordered_concat(owned, ["page_id", f"{prefix}_open"], "pos", "text")


def parent_of(elements: DataFrame) -> DataFrame:
    """``(page_id, open_pos) -> parent_open`` for properly nested elements.

    Depth = open elements before the element (running sum of +1 at opens and
    -1 at stops); the parent is the last element opened one level up.
    """
    ev = dealt(elements, ["page_id"],
               F.struct(F.col("open_pos").alias("pos"), F.lit(1).alias("d"), F.lit(1).alias("o"), F.col("open_pos")),
               F.struct(F.col("stop_pos").alias("pos"), F.lit(-1).alias("d"), F.lit(0).alias("o"), F.lit(None).cast("int").alias("open_pos")))
    w = Window.partitionBy("page_id").orderBy("pos", "o").rowsBetween(*RUN)
    lv = ev.withColumn("lvl", F.sum("d").over(w) - 1).filter("o = 1").select("page_id", "open_pos", "lvl")
    no = F.lit(None).cast("int")
    rows = dealt(lv, ["page_id"],
                 F.struct(F.col("lvl"), F.col("open_pos").alias("pos"), F.col("open_pos").alias("cand"), no.alias("child")),
                 F.struct((F.col("lvl") - 1).alias("lvl"), F.col("open_pos").alias("pos"), no.alias("cand"), F.col("open_pos").alias("child")))
    w2 = Window.partitionBy("page_id", "lvl").orderBy("pos", F.col("child").isNotNull()).rowsBetween(*RUN)
    r = rows.withColumn("parent_open", F.last("cand", ignorenulls=True).over(w2))
    return r.filter(F.col("child").isNotNull()).select("page_id", F.col("child").alias("open_pos"), "parent_open")


# ---------------------------------------------------------------- E3 images
def images(conv) -> DataFrame:
    """E3 (+P6, P12, J4, F2): kept images with their resolved source."""
    e = conv.written_out(conv.kept_elements.filter(F.col("tag").isin("img", "picture", "source")))  # read three times
    img = e.filter(F.col("tag") == "img")
    lazy = F.coalesce(*[F.when((F.coalesce(attr("attrs", a), F.lit("")) != "")
                               & ~attr("attrs", a).startswith("data:"), attr("attrs", a)) for a in LAZY_SRC_ATTRS])
    from_srcset = F.coalesce(*[F.when(F.coalesce(attr("attrs", a), F.lit("")) != "", X.best_srcset(attr("attrs", a)))
                               for a in SRCSET_ATTRS])
    img = img.select("page_id", "open_pos", "attrs", lazy.alias("lazy"), from_srcset.alias("from_srcset"))
    # The first usable <source> of the enclosing <picture>
    pic = e.filter(F.col("tag") == "picture").select("page_id", "open_pos", "end_pos")
    src_el = e.filter(F.col("tag") == "source").select(
        "page_id", F.col("open_pos").alias("pos"),
        _first_truthy(attr("attrs", "data-srcset"), attr("attrs", "srcset"), attr("attrs", "data-src")).alias("set"),
        (attr("attrs", "srcset").isNotNull() | attr("attrs", "data-srcset").isNotNull()
         | attr("attrs", "data-src").isNotNull()).alias("sel"))
    src_el = src_el.filter("sel").withColumn("best", X.best_srcset(F.col("set"))).filter(F.col("best").isNotNull())
    owned = assign_owner(src_el.select("page_id", "pos", "best"), pic, "pic")
    first_src = owned.groupBy("page_id", "pic_open").agg(F.min_by("best", "pos").alias("from_picture"))
    img_pic = assign_owner(img.select("page_id", F.col("open_pos").alias("pos")), pic, "pic")
    img = img.join(img_pic.select("page_id", F.col("pos").alias("open_pos"), "pic_open"), ["page_id", "open_pos"], "left")
    img = img.join(first_src, ["page_id", "pic_open"], "left")
    img = img.join(conv.corpus.page_info.select("page_id", "url"), "page_id")
    chosen = F.coalesce("lazy", "from_srcset", "from_picture", _truthy(attr("attrs", "src")))
    src = U.safe_src(F.when(chosen.isNotNull(), U.resolve_url(chosen, F.col("url"))).otherwise(F.lit("")))
    return img.select(
        "page_id", F.col("open_pos").alias("pos"), src.alias("src"),
        F.coalesce(attr("attrs", "alt"), F.lit("")).alias("alt"),
        F.coalesce(attr("attrs", "title"), F.lit("")).alias("title"),
        X.int_prefix(attr("attrs", "width")).alias("width"), X.int_prefix(attr("attrs", "height")).alias("height"),
        F.when(src != "", F.concat(F.lit("!["), X.trim_ws(F.coalesce(attr("attrs", "alt"), F.lit(""))), F.lit("]("), src,
                                   F.when(X.trim_ws(F.coalesce(attr("attrs", "title"), F.lit(""))) != "",
                                          F.concat(F.lit(' "'), X.trim_ws(attr("attrs", "title")), F.lit('"')))
                                   .otherwise(F.lit("")), F.lit(")"))).otherwise(F.lit("")).alias("markdown"))


# ---------------------------------------------------------------- E4 media
def media(conv) -> DataFrame:
    """E4 (+A6, J5, F11): iframe/video/audio described as a quote line."""
    e = conv.selector_survivors
    m = e.filter(F.col("tag").isin("iframe", "video", "audio"))
    own = _first_truthy(*[attr("attrs", a) for a in MEDIA_SRC_ATTRS])
    src_el = e.filter((F.col("tag") == "source") & F.exists(
        F.map_keys("attrs"), lambda k: k.isin(*MEDIA_SRC_ATTRS))).select(
        "page_id", F.col("open_pos").alias("pos"), _first_truthy(*[attr("attrs", a) for a in MEDIA_SRC_ATTRS]).alias("s"))
    av = m.filter(F.col("tag").isin("video", "audio")).select("page_id", "open_pos", "end_pos")
    owned = assign_owner(src_el, av, "m")
    nested = owned.groupBy("page_id", "m_open").agg(F.min_by(F.coalesce("s", F.lit("")), "pos").alias("nested"))
    m = m.join(nested.withColumnRenamed("m_open", "open_pos"), ["page_id", "open_pos"], "left")
    m = m.join(conv.corpus.page_info.select("page_id", "url"), "page_id")
    raw = F.coalesce(own, F.when(F.col("tag").isin("video", "audio"), F.col("nested")), F.lit(""))
    resolved = U.safe_src(F.when(raw != "", U.resolve_url(raw, F.col("url"))).otherwise(F.lit("")))
    m = m.select("page_id", "open_pos", F.col("tag").alias("type"), resolved.alias("murl"),
                 F.coalesce(_first_truthy(*[attr("attrs", a) for a in MEDIA_TITLE_ATTRS]), F.lit("")).alias("title"))
    provider = F.when(F.col("murl") != "", U.url_provider(F.col("murl"))).otherwise(F.lit(""))
    m = m.withColumn("provider", provider)
    desc = F.concat_ws(" — ", F.concat(F.lit("Embedded "), F.col("type")),
                       F.when(F.col("provider") != "", F.concat(F.lit("from "), F.col("provider"))),
                       F.when(F.col("title") != "", F.concat(F.lit('"'), F.col("title"), F.lit('"'))),
                       F.when(F.col("murl") != "", F.col("murl")))
    return m.select("page_id", F.col("open_pos").alias("pos"), "type", F.col("murl").alias("url"), "provider", "title",
                    desc.alias("description"))


# ---------------------------------------------------------------- E5 svgs
def svgs(conv) -> DataFrame:
    """Action per SVG: removed (icon or redundant), described, or diagram."""
    texts = conv.after_selectors.filter(F.col("kind") == "text").select("page_id", "pos", "kind", "text")
    e, toks = conv.of_pages_with("svg", conv.selector_survivors, conv.selector_survivors, texts)
    svg = e.filter(F.col("tag") == "svg")
    svg = svg.select("page_id", "open_pos", "end_pos", "stop_pos", icon_svg().alias("icon"),
                     X.trim_ws(attr("attrs", "aria-label")).alias("aria"))
    svg = materialize(svg.join(parent_of(e.select("page_id", "open_pos", "stop_pos")), ["page_id", "open_pos"], "left"))
    spans = svg.select("page_id", "open_pos", "end_pos")

    def first_child_text(tag):
        c = e.filter(F.col("tag") == tag).select("page_id", F.col("open_pos").alias("pos"), "end_pos")
        owned = assign_owner(c, spans, "s")
        first = owned.groupBy("page_id", "s_open").agg(F.min("pos").alias("c_open"))
        c_el = first.join(c.withColumnRenamed("pos", "c_open"), ["page_id", "c_open"])
        txt = element_text(c_el.select("page_id", F.col("c_open").alias("open_pos"), "end_pos"), toks, "c")
        return c_el.join(txt, ["page_id", "c_open"], "left").select(
            "page_id", F.col("s_open").alias("open_pos"), X.trim_ws(F.coalesce("text", F.lit(""))).alias(tag))

    above = svg
    svg = svg.join(first_child_text("title"), ["page_id", "open_pos"], "left")
    svg = svg.join(first_child_text("desc"), ["page_id", "open_pos"], "left")
    stxt = element_text(spans, toks, "s").select("page_id", F.col("s_open").alias("open_pos"),
                                                  F.length(X.trim_ws("text")).alias("svg_len"))
    par = above.select("page_id", F.col("parent_open").alias("open_pos")).distinct().join(
        e.select("page_id", "open_pos", "end_pos"), ["page_id", "open_pos"])
    ptxt = element_text(par, toks, "p").select("page_id", F.col("p_open").alias("parent_open"),
                                               F.length(X.trim_ws("text")).alias("parent_len"))
    svg = svg.join(stxt, ["page_id", "open_pos"], "left").join(ptxt, ["page_id", "parent_open"], "left")
    desc = _first_truthy(F.col("title"), F.col("desc"), F.col("aria"))
    action = (F.when(F.col("icon"), F.lit("removed"))
              .when(desc.isNotNull(), F.lit("described"))
              .when(F.col("parent_open").isNotNull()
                    & (F.coalesce("parent_len", F.lit(0)) > F.coalesce("svg_len", F.lit(0))), F.lit("removed"))
              .otherwise(F.lit("diagram")))
    text = (F.when(action == "described", F.concat(F.lit("[SVG: "), desc, F.lit("]")))
            .when(action == "diagram", F.lit("[SVG diagram]")))
    return svg.select("page_id", F.col("open_pos").alias("pos"), action.alias("action"), text.alias("description"))


# ---------------------------------------------------------------- E8 code blocks
# Attributes of ``pre`` and ``code`` that name the language or the title, in order.
LANGUAGE_ATTRS = ["data-language", "data-lang", "lang"]
TITLE_ATTRS = ["data-title", "title"]


# Widgets of code figures, which are no part of the code or of the text.
FIGURE_WIDGET_CLASSES = ["CodeBlockPanel", "ScrollAreaScrollbar"]
ROLE_FIGURE_WIDGET_ROLES = ["tablist", "combobox"]


def _is_code_figure():
    return attr("attrs", "data-rehype-pretty-code-figure").isNotNull()


def code_widgets(conv) -> DataFrame:
    """P10: buttons and panels inside code figures, buttons and tab lists inside ``role=figure``
    containers; only where the container has a ``pre``. ``(page_id, open_pos, stop_pos)``."""
    e = conv.code_pages[0]
    pres = e.filter(F.col("tag") == "pre").select("page_id", F.col("open_pos").alias("pos"))
    button = F.col("tag") == "button"
    panel = F.lit(False)
    for c in FIGURE_WIDGET_CLASSES:
        panel = panel | has_class("attrs", c)
    found = None
    for box, widget in ((_is_code_figure(), button | panel),
                        (attr("attrs", "role") == "figure", button | attr("attrs", "role").isin(*ROLE_FIGURE_WIDGET_ROLES))):
        # of nested containers the outer ones hold all that the inner ones hold
        boxes = e.filter(box).select("page_id", "open_pos", "end_pos")
        filled = assign_owner(pres, outermost(boxes), "x").select("page_id", F.col("x_open").alias("open_pos")).distinct()
        boxes = boxes.join(filled, ["page_id", "open_pos"])
        inside = e.filter(widget).select("page_id", F.col("open_pos").alias("pos"), "stop_pos")
        hit = assign_owner(inside, boxes, "x").select("page_id", F.col("pos").alias("open_pos"), "stop_pos")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def _first_inside(inner: DataFrame, owners: DataFrame) -> DataFrame:
    """The first of ``inner(page_id, pos, ...)`` in each owner: ``(page_id, x_open, pos, ...)``."""
    owned = assign_owner(inner, owners, "x")
    return owned.withColumn("_rn", F.row_number().over(Window.partitionBy("page_id", "x_open").orderBy("pos"))) \
        .filter("_rn = 1").drop("_rn")


def _first_text_inside(inner: DataFrame, owners: DataFrame, toks: DataFrame, name: str) -> DataFrame:
    """Text of the first of ``inner(page_id, pos, end_pos)`` in each owner: ``(page_id, x_open, name)``."""
    first = _first_inside(inner, owners)
    text = element_text(first.select("page_id", F.col("pos").alias("open_pos"), "end_pos"), toks, "t")
    text = text.select("page_id", F.col("t_open").alias("pos"), F.col("text").alias(name))
    return first.join(text, ["page_id", "pos"], "left").select("page_id", "x_open", name)


def labelled_by(conv) -> DataFrame:
    """Text of the element that a code figure names in ``aria-labelledby``, the first of its id
    anywhere in the page. ``(page_id, pos, label_id, label)``; NULL where there is none."""
    fig = conv.kept_elements.filter(_is_code_figure()).select(
        "page_id", F.col("open_pos").alias("pos"), _truthy(attr("attrs", "aria-labelledby")).alias("label_id"))
    fig = fig.filter(F.col("label_id").isNotNull())
    first = Window.partitionBy("page_id", "label_id").orderBy("open_pos")
    named = conv.elements.select("page_id", F.col("id").alias("label_id"), "open_pos", "end_pos").join(
        fig.select("page_id", "label_id").distinct(), ["page_id", "label_id"])
    named = named.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    text = element_text(named.select("page_id", "open_pos", "end_pos"), conv.corpus.tokens, "l")
    named = named.join(text.withColumnRenamed("l_open", "open_pos"), ["page_id", "open_pos"], "left").select(
        "page_id", "label_id", F.col("text").alias("label"))
    return fig.join(named, ["page_id", "label_id"], "left").select("page_id", "pos", "label_id", "label")


def code_blocks(conv, fenced_only: bool = False) -> DataFrame:
    """E8 (+F5, F8, F14, F16, J3, J6, J7, P10, R3): language, title, code and fence per ``pre``.

    The first ``pre`` of a code figure takes the language of the figure's first ``data-language`` element
    and the title of its first panel title, or else of its label, where it has none of its own; then the
    widgets go. A ``pre`` of a demo container falls back to the selected tab. ``fenced_only`` leaves out a
    ``pre`` without a ``code`` element: it renders as text.
    """
    e, cleaned = conv.code_pages
    widgets = conv.code_widgets
    # written in pieces: a stage holds a sort for each window and join in it, and they share a task's memory
    toks = materialize(sweep_keep(cleaned, widgets))
    left = e.join(toks.filter(F.col("kind").isin("open", "void", "raw")).select("page_id", F.col("pos").alias("open_pos")),
                  ["page_id", "open_pos"], "left_semi")
    pre = e.filter(F.col("tag") == "pre").select("page_id", "open_pos", "end_pos", "attrs")
    spans = pre.select("page_id", "open_pos", "end_pos")
    code = e.filter(F.col("tag") == "code").select("page_id", F.col("open_pos").alias("pos"), "end_pos",
                                                  F.col("attrs").alias("c_attrs"))
    owned = assign_owner(code, spans, "p")
    first_code = owned.withColumn("_rn", F.row_number().over(Window.partitionBy("page_id", "p_open").orderBy("pos"))) \
        .filter("_rn = 1").select("page_id", F.col("p_open").alias("open_pos"), F.col("pos").alias("code_open"),
                                  F.col("end_pos").alias("code_end"), "c_attrs")
    pre = pre.join(first_code, ["page_id", "open_pos"], "left")
    # Closest enclosing code figure and demo container
    fig = e.filter(_is_code_figure()).select("page_id", "open_pos", "end_pos", F.col("attrs").alias("f_attrs"))
    f_spans = fig.select("page_id", "open_pos", "end_pos")
    at = pre.select("page_id", F.col("open_pos").alias("pos"))
    demo = e.filter(attr("attrs", "data-demo").isNotNull()).select("page_id", "open_pos", "end_pos")
    in_demo = assign_owner(at, demo, "d").select("page_id", F.col("pos").alias("open_pos"), "d_open")
    pre = pre.join(in_demo, ["page_id", "open_pos"], "left")
    pf = assign_owner(pre.select("page_id", F.col("open_pos").alias("pos")), fig.select("page_id", "open_pos", "end_pos"), "f")
    pre = pre.join(pf.select("page_id", F.col("pos").alias("open_pos"), "f_open"), ["page_id", "open_pos"], "left")
    pre = pre.join(fig.select("page_id", F.col("open_pos").alias("f_open"), "f_attrs"), ["page_id", "f_open"], "left")
    pre = materialize(pre)
    # What a figure's first pre takes from the figure, before the widgets go
    first_pre = _first_inside(at, f_spans).select("page_id", F.col("pos").alias("open_pos"), F.lit(True).alias("is_first"))
    pre = pre.join(first_pre, ["page_id", "open_pos"], "left")

    def place(df, cond):
        return df.filter(cond).select("page_id", F.col("open_pos").alias("pos"), "end_pos")

    panel_lang = e.filter(attr("attrs", "data-language").isNotNull()).select(
        "page_id", F.col("open_pos").alias("pos"),
        _first_truthy(attr("attrs", "data-language"), attr("attrs", "data-lang")).alias("panel_lang"))
    panel_lang = _first_inside(panel_lang, f_spans)
    panel_title = has_class("attrs", "CodeBlockPanelTitle")
    rehype_title = attr("attrs", "data-rehype-pretty-code-title").isNotNull()
    for found in (panel_lang,
                  _first_text_inside(place(e, panel_title), f_spans, cleaned, "own_panel"),
                  _first_text_inside(place(left, rehype_title), f_spans, toks, "fig_title"),
                  _first_text_inside(place(left, panel_title), f_spans, toks, "panel_title"),
                  labelled_by(conv).select("page_id", F.col("pos").alias("x_open"), "label")):
        found = materialize(found.withColumnRenamed("x_open", "f_open").drop("pos"))
        pre = pre.join(found, ["page_id", "f_open"], "left")
    tab = (attr("attrs", "role") == "tab") & (attr("attrs", "aria-selected") == "true")
    for found in (_first_text_inside(place(left, tab), demo, toks, "tab"),
                  _first_text_inside(place(left, attr("attrs", "data-selected").isNotNull()), demo, toks, "selected")):
        pre = pre.join(materialize(found.withColumnRenamed("x_open", "d_open")), ["page_id", "d_open"], "left")
    pre = materialize(pre)
    # code text: the code element's text, else the pre's
    ctext = element_text(pre.filter(F.col("code_open").isNotNull()).select(
        "page_id", F.col("code_open").alias("open_pos"), F.col("code_end").alias("end_pos")), toks, "c")
    ptext = element_text(spans, toks, "q")
    pre = pre.join(ctext.select("page_id", F.col("c_open").alias("code_open"), F.col("text").alias("code_text")),
                   ["page_id", "code_open"], "left")
    pre = pre.join(ptext.select("page_id", F.col("q_open").alias("open_pos"), F.col("text").alias("pre_text")),
                   ["page_id", "open_pos"], "left")
    pa, ca, fa = (lambda n: attr("attrs", n)), (lambda n: attr("c_attrs", n)), (lambda n: attr("f_attrs", n))

    def class_lang(c):
        toks_ = F.split(F.coalesce(c, F.lit("")), f"[{X.WS}]+")
        hits = F.filter(F.transform(toks_, lambda t: F.regexp_extract(t, CLASS_LANGUAGE_RE, 1)), lambda x: x != "")
        return hits

    cls = F.concat(class_lang(pa("class")), class_lang(ca("class")))
    given_lang = F.coalesce(_truthy(pa("data-language")), F.when(F.col("is_first"), F.col("panel_lang")))
    given_title = F.coalesce(_truthy(pa("data-title")), F.when(F.col("is_first"), _first_truthy(
        X.trim_ws("own_panel"), X.trim_ws("label"))))
    lang = X.first_non_empty(given_lang, *[pa(n) for n in LANGUAGE_ATTRS], *[ca(n) for n in LANGUAGE_ATTRS],
                             fa("data-language"), X.first_non_empty_array(cls))
    title = X.first_non_empty(given_title, *[pa(n) for n in TITLE_ATTRS], *[ca(n) for n in TITLE_ATTRS],
                              F.col("fig_title"), F.col("panel_title"), F.col("label"), F.col("tab"), F.col("selected"))
    title = F.when(title.isNotNull(), X.squash_ws(title))
    code_raw = F.coalesce(_truthy(F.col("code_text")), F.col("pre_text"), F.lit(""))
    code_txt = X.trim_fence_padding(code_raw)
    lang = F.lower(lang)
    info = F.concat_ws(" ", lang, F.when(title.isNotNull(), F.concat(F.lit('title="'), X.escape_info_string(title), F.lit('"'))))
    info = F.when(info != "", F.concat(F.lit(" "), info)).otherwise(F.lit(""))
    md = F.concat(F.lit("```"), info, F.lit("\n"), code_txt, F.lit("\n```"))
    if fenced_only:
        pre = pre.filter(F.col("code_open").isNotNull())
    return pre.select("page_id", F.col("open_pos").alias("pos"), lang.alias("language"), title.alias("title"),
                      code_txt.alias("code"), md.alias("markdown"))


# ---------------------------------------------------------------- E11 tables
def table_cells(conv) -> DataFrame:
    """``(page_id, table_pos, row, col, is_header, text)``; rows/cols 1-based in document order.

    ``text`` is the Markdown of the cell in one line, with note references and images. A table inside a cell is text of it.
    """
    e = conv.written_out(conv.kept_elements.filter(F.col("tag").isin("table", "tr", "td", "th")).select("page_id", "open_pos", "end_pos", "tag"))

    def outer(*tags):
        return outermost(e.filter(F.col("tag").isin(*tags)))

    tables = outer("table").select("page_id", "open_pos", "end_pos")
    trs = outer("tr").select("page_id", F.col("open_pos").alias("pos"), "end_pos")
    tr_t = assign_owner(trs, tables, "t")
    tr_t = tr_t.withColumn("row", F.row_number().over(Window.partitionBy("page_id", "t_open").orderBy("pos")))
    cells = outer("td", "th").select("page_id", F.col("open_pos").alias("pos"), "end_pos", "tag")
    c_tr = assign_owner(cells, tr_t.select("page_id", F.col("pos").alias("open_pos"), "end_pos"), "r")
    c_tr = c_tr.withColumn("col", F.row_number().over(Window.partitionBy("page_id", "r_open").orderBy("pos")))
    c_tr = c_tr.join(tr_t.select("page_id", F.col("pos").alias("r_open"), "t_open", "row"), ["page_id", "r_open"])
    replaced = conv.inline_images
    if conv.notes is not None:
        replaced = replaced.unionByName(conv.notes[0])
    txt = inline_markdown(conv, cells.select("page_id", F.col("pos").alias("open_pos"), "end_pos"), replaced)
    c_tr = c_tr.join(txt.select("page_id", F.col("c_open").alias("pos"), "md"), ["page_id", "pos"], "left")
    clean = F.replace(F.coalesce("md", F.lit("")), F.lit("|"), F.lit("\\|"))
    return c_tr.select("page_id", F.col("t_open").alias("table_pos"), F.col("row").cast("long").alias("row"),
                       F.col("col").cast("long").alias("col"), (F.col("tag") == "th").alias("is_header"),
                       clean.alias("text"))


def render_tables(cells: DataFrame) -> DataFrame:
    """GFM table text per table (header rule after the first row)."""
    cells = materialize(cells)  # read twice
    rows = ordered_concat(cells.withColumn("cell", F.concat(F.lit(" "), F.col("text"), F.lit(" |"))),
                          ["page_id", "table_pos", "row"], "col", "cell", "", "line")
    ncols = cells.filter("row = 1").groupBy("page_id", "table_pos").agg(F.count("*").alias("n"))
    rows = rows.withColumn("line", F.concat(F.lit("|"), F.col("line")))
    rows = rows.join(ncols, ["page_id", "table_pos"], "left").withColumn(
        "line", F.when(F.col("row") == 1, F.concat(F.col("line"), F.lit("\n|"),
                                                   F.repeat(F.lit(" --- |"), F.coalesce("n", F.lit(1)).cast("int"))))
        .otherwise(F.col("line")))
    return ordered_concat(rows, ["page_id", "table_pos"], "row", "line", "\n", "markdown")


# ---------------------------------------------------------------- E10 figures
def figures(conv, imgs: DataFrame | None = None) -> DataFrame:
    """E10 + J8: figures that contain images -> images (Markdown, blank line
    between) and an italic caption from the first ``figcaption``. A figure
    without an image is rendered as ordinary content instead (kept text)."""
    e = conv.kept_elements
    toks = conv.cleaned_tokens
    fig = e.filter(F.col("tag") == "figure").select("page_id", "open_pos", "end_pos")
    imgs = imgs if imgs is not None else conv.images
    owned = assign_owner(imgs.select("page_id", "pos", "markdown"), fig, "f")
    with_img = owned.groupBy("page_id", "f_open").agg(F.count("*").alias("n_img"))
    md = ordered_concat(owned.filter(F.col("markdown") != ""), ["page_id", "f_open"], "pos", "markdown", "\n\n", "img_md")
    cap = e.filter(F.col("tag") == "figcaption").select("page_id", F.col("open_pos").alias("pos"), "end_pos")
    cap_own = assign_owner(cap, fig, "f")
    first_cap = cap_own.groupBy("page_id", "f_open").agg(F.min("pos").alias("c_open"))
    first_cap = first_cap.join(cap.withColumnRenamed("pos", "c_open"), ["page_id", "c_open"])
    ctext = element_text(first_cap.select("page_id", F.col("c_open").alias("open_pos"), "end_pos"), toks, "c")
    first_cap = first_cap.join(ctext, ["page_id", "c_open"], "left").select(
        "page_id", "f_open", X.trim_ws(F.coalesce("text", F.lit(""))).alias("caption"))
    f = with_img.join(md, ["page_id", "f_open"], "left").join(first_cap, ["page_id", "f_open"], "left")
    caption = F.coalesce("caption", F.lit(""))
    out = F.concat(F.lit("\n\n"), F.coalesce("img_md", F.lit("")),
                   F.when(caption != "", F.concat(F.lit("\n\n_"), caption, F.lit("_"))).otherwise(F.lit("")), F.lit("\n\n"))
    return f.select("page_id", F.col("f_open").alias("pos"), F.col("n_img").cast("long").alias("images"),
                    caption.alias("caption"), out.alias("markdown"))
