"""Page -> Markdown document, as one lazy DataFrame plan.

Stages (each a relation, all keyed and partitioned by ``page_id``):

1. ``root``      W4/J1: content root per page (site selector, else first
                 ``article``/``main``, else the container with the best text
                 score, else ``body``, else the whole page).
2. ``content``   tokens strictly inside the root.
3. ``cleaned``   P1 default selectors, P2 site removals, P4 hidden, P5 empty,
                 P6 tiny images (sweeps over the token stream).
4. ``headings``  E6/W1 text, slug and id; ``toc`` A2.
5. ``links``     E2 cleaned absolute hrefs.
6. ``render``    R1-R6 fragments ordered by position, two-level ordered
                 aggregation (per 4096-token chunk, then per page) -> body.
7. ``documents`` F6 post-processing, footnotes A5, front matter F17, F18.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions.keys import same
from ..operators import clean as C
from ..operators import select as S
from ..operators.content import BLOCKS, CONTAINERS, best_container
from ..operators.sanitize import DROPPED_WITH_CONTENT
from ..operators.tokens import BLOCK_TAGS, attr
from ..session import taken_over
from ..sources import rules as R
from .corpus import Corpus
from .intervals import assign_owner, dealt, interval_sums, ordered_concat, sweep_keep
from .materialize import materialize
from .render_rules import render_rules, written

PAGE_END = 1 << 30
CHUNK = 4096
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# Root fallback selectors after the site selector, in order.
ROOT_FALLBACK = [(1, "main"), (2, "article, main"), (4, "body")]
SCORED = 3  # the place of the best container by text score among them


# A part of a rendered page says one thing: text, a break, or that a quote or list item begins or ends.
PART_SAYS = "md IS NOT NULL OR brk IS NOT NULL OR push IS NOT NULL OR pop IS NOT NULL"


def _part(k1, k2, k3, k4: int, md=None, brk=None, nested=None, push=None, pop=None, marker=None, how=None):
    """A part and its place: token, close (0) before open (1), inner closes first, place in the element.

    ``how``: ``text`` is a page's own text, whose line starts are escaped, ``code`` is taken over as it is.
    """
    text = F.when(md != "", md) if md is not None else F.lit(None)
    return F.struct(
        k1.cast("int").alias("k1"), k2.cast("int").alias("k2"), k3.cast("int").alias("k3"), F.lit(k4).alias("k4"),
        text.cast("string").alias("md"), (F.lit(None) if brk is None else brk).cast("int").alias("brk"),
        (F.lit(None) if nested is None else nested).cast("boolean").alias("nested"),
        (F.lit(None) if push is None else push).cast("string").alias("push"),
        (F.lit(None) if pop is None else pop).cast("int").alias("pop"),
        (F.lit(None) if marker is None else marker).cast("string").alias("marker"),
        (F.lit(None) if how is None else how).cast("string").alias("how"))


@dataclass
class Options:
    """``gfm``: tables, struck text and task boxes; ``render_rules``: rows added to the renderer's rules (``render_rules.SCHEMA``)."""

    retrieved: str = "2025-01-01T00:00:00.000Z"
    extra_remove: tuple[str, ...] = ()
    gfm: bool = True
    render_rules: DataFrame | None = None


class Conversion:
    """All relations of one conversion run; attributes are lazy DataFrames."""

    def __init__(self, spark: SparkSession, corpus: Corpus, rules: DataFrame | None = None,
                 options: Options | None = None, alternates: DataFrame | None = None):
        self.spark = corpus.spark  # plans of pages have a session of their own
        self.given = corpus
        self.rules = rules if rules is not None else R.builtin_rules(spark)
        self.opt = options or Options()
        self.alternates = alternates
        self._cache: dict = {}

    # ------------------------------------------------------------ canonical
    @property
    def canonical(self) -> DataFrame | None:
        """``(page_id, content)`` of pages whose published Markdown wins, or None."""
        if self.alternates is None:
            return None

        def build():
            from ..sources.canonical import canonical_content, canonical_link
            return materialize(canonical_content(canonical_link(self.given.pages), taken_over(self.spark, self.alternates)))
        return self._memo("canonical", build)

    @property
    def corpus(self) -> Corpus:
        """The corpus given; of pages with usable alternates only the tags that metadata come from are tokenised."""
        def build():
            self.given.pages = materialize(self.given.pages)  # cut: links and tokens read them
            return self.given.heads_of(self.canonical.select("page_id"))
        return self.given if self.alternates is None else self._memo("corpus", build)

    def _memo(self, key, fn):
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    # ------------------------------------------------------------ elements + host
    @property
    def elements(self) -> DataFrame:
        return self.corpus.elements_attrs

    @property
    def page_rules(self) -> DataFrame:
        """Each page's site rule by exact host (none -> NULLs)."""
        return self._memo("page_rules", lambda: R.page_rule_join(self.corpus.page_info, self.rules))

    # ------------------------------------------------------------ root
    @property
    def root(self) -> DataFrame:
        def build():
            els = self.elements
            g_rules = self.spark.createDataFrame([("*", r, s) for r, s in ROOT_FALLBACK], S.RULE_SCHEMA)
            # the fallback selectors name tags only; site selectors concern pages of hosts with a rule only
            g = S.match(S.facts(els.filter(F.col("tag").isin("main", "article", "body"))), S.conditions(g_rules))
            s_rules = self.rules.select(F.col("domain").alias("scope"), F.lit(0).alias("rule_ord"), "selector")
            with_rule = self.page_rules.filter(F.col("domain").isNotNull()).select("page_id")
            s = S.match(S.facts(els.join(with_rule, "page_id", "left_semi")), S.conditions(s_rules), by_host=True)
            g = g.join(with_rule.withColumn("_r", F.lit(1)), "page_id", "left").filter(
                (F.col("rule_ord") > 1) | F.col("_r").isNull()).drop("_r")
            cand = g.unionByName(s).join(els.select("page_id", "open_pos", "end_pos"), ["page_id", "open_pos"])
            # a page that names no main element: the container with the most text
            cand = materialize(cand.select("page_id", "open_pos", "rule_ord", "end_pos"))
            named = cand.filter(F.col("rule_ord") < SCORED).select("page_id").distinct()
            unnamed = materialize(self.corpus.page_info.select("page_id").join(named, "page_id", "left_anti"))
            if not unnamed.isEmpty():  # else no text is read for scores
                spans = materialize(els.filter(F.col("tag").isin("a", *BLOCKS, *CONTAINERS)).select("page_id", "open_pos", "end_pos", "tag").join(unnamed, "page_id", "left_semi"))
                texts = materialize(self.corpus.texts.join(unnamed, "page_id", "left_semi"))
                cand = cand.unionByName(best_container(spans, texts).withColumn("rule_ord", F.lit(SCORED)))
            w = Window.partitionBy("page_id").orderBy("rule_ord", "open_pos")
            best = cand.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            best = best.select("page_id", F.col("open_pos").alias("root_open"), F.col("end_pos").alias("root_end"))
            return materialize(self.corpus.page_info.select("page_id").join(best, "page_id", "left").select(
                "page_id", F.coalesce("root_open", F.lit(-1)).alias("root_open"),
                F.coalesce("root_end", F.lit(PAGE_END)).alias("root_end")))
        return self._memo("root", build)

    # ------------------------------------------------------------ content + cleaning
    @property
    def content_tokens(self) -> DataFrame:
        def build():
            t = self.corpus.tokens.join(self.root, "page_id")
            if self.canonical is not None:  # J9: pages with usable alternates skip conversion
                t = t.join(self.canonical.select("page_id"), "page_id", "left_anti")
            # not cut: the selector removals read it once
            return t.filter((F.col("pos") > F.col("root_open")) & (F.col("pos") < F.col("root_end"))).drop("root_open", "root_end", "tok")
        return self._memo("content_tokens", build)

    @property
    def content_elements(self) -> DataFrame:
        def build():
            e = self.elements.join(self.root, "page_id")
            return materialize(e.filter((F.col("open_pos") > F.col("root_open")) & (F.col("open_pos") < F.col("root_end"))).drop(
                "root_open", "root_end"))
        return self._memo("content_elements", build)

    def _site_removals(self) -> DataFrame:
        r = self.rules.select(F.col("domain").alias("scope"), F.posexplode(F.coalesce("remove", F.array().cast("array<string>"))).alias("rule_ord", "selector"))
        return r

    def _extra_removals(self) -> DataFrame:
        return self.spark.createDataFrame([("*", 100 + i, s) for i, s in enumerate(self.opt.extra_remove)], S.RULE_SCHEMA)

    @property
    def unsupported(self) -> DataFrame:
        """``(page_id, selectors)`` of pages with selectors outside the supported syntax, which match nothing.

        Those of the options concern every page; those of a site's rule its pages. A rule's selectors make one row, and
        the rows are broadcast if they are ``S.BROADCAST_MAX_CONDITIONS`` at most.
        """
        def build():
            rules = taken_over(self.spark, self.rules)
            site = rules.select(F.col("domain").alias("scope"), F.lit(0).alias("rule_ord"), "selector").unionByName(self._site_removals())
            names = F.array_join(F.array_sort(F.collect_set("sel")), ", ")
            bad = materialize(S.quarantine(site).groupBy("scope").agg(names.alias("of_site")))
            few = bad.limit(S.BROADCAST_MAX_CONDITIONS + 1).count() <= S.BROADCAST_MAX_CONDITIONS
            pages = self.corpus.page_info.select("page_id", "host")
            found = pages.join(F.broadcast(bad) if few else bad, same((F.col("host"), F.col("scope"))), "left")
            everywhere = S.quarantine(self._extra_removals()).agg(names).first()[0] if self.opt.extra_remove else ""
            found = found.withColumn("everywhere", F.lit(everywhere or None).cast("string"))
            return found.select("page_id", F.concat_ws(", ", "of_site", "everywhere").alias("selectors")).filter("selectors <> ''")
        return self._memo("unsupported", build)

    @property
    def after_selectors(self) -> DataFrame:
        """P1 then P2 (and H4 extra selectors, applied like the defaults), with what P9 lets go with all it holds."""
        def build():
            t, e = self.content_tokens, self.content_elements
            unsafe = self.spark.createDataFrame([("*", 99, ", ".join(DROPPED_WITH_CONTENT))], S.RULE_SCHEMA)  # P9
            defaults = S.default_rules(self.spark).unionByName(unsafe).unionByName(self._extra_removals())
            # cut: the next sweep reads these tokens three times
            return materialize(C.remove_selector_sets(t, e, [(defaults, False), (self._site_removals(), True)]))
        return self._memo("after_selectors", build)

    @property
    def cleaned_tokens(self) -> DataFrame:
        def build():
            tiny = self.content_elements.filter((F.col("tag") == "img") & C.tiny_image()).select(
                "page_id", "open_pos", "stop_pos")
            return materialize(C.hidden_and_empty(self.after_selectors, self.content_elements, tiny))
        return self._memo("cleaned_tokens", build)

    @property
    def kept_elements(self) -> DataFrame:
        def build():
            opens = self.cleaned_tokens.filter(F.col("kind").isin("open", "void", "raw")).select(
                "page_id", F.col("pos").alias("open_pos"))
            return materialize(self.content_elements.join(opens, ["page_id", "open_pos"], "left_semi"))
        return self._memo("kept_elements", build)

    # ------------------------------------------------------------ headings / toc
    @property
    def headings(self) -> DataFrame:
        """E6 + W1: ``(page_id, pos, level, text, id, slug)``."""
        def build():
            h = self.kept_elements.filter(F.col("tag").isin(*HEADINGS)).select(
                "page_id", "open_pos", "end_pos", "tag", F.col("id").alias("given_id"))
            txt = self.cleaned_tokens.filter(F.col("kind") == "text").select("page_id", "pos", "text")
            owned = assign_owner(txt, h.select("page_id", "open_pos", "end_pos"), "h")
            ht = ordered_concat(owned, ["page_id", "h_open"], "pos", "text").withColumnRenamed("h_open", "open_pos")
            h = h.join(ht, ["page_id", "open_pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))
            base = F.when(F.coalesce(F.col("given_id"), F.lit("")) != "", F.col("given_id")).otherwise(X.slugify("text"))
            h = h.withColumn("base", base)
            n = F.row_number().over(Window.partitionBy("page_id", "base").orderBy("open_pos")) - 1
            h = h.withColumn("n", n)
            slug = F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string")))
            return materialize(h.select(
                "page_id", F.col("open_pos").alias("pos"), F.substring("tag", 2, 1).cast("int").alias("level"),
                "text", F.when(F.coalesce(F.col("given_id"), F.lit("")) != "", F.col("given_id")).otherwise(slug).alias("id"),
                slug.alias("slug")))
        return self._memo("headings", build)

    @property
    def toc(self) -> DataFrame:
        """A2: ``(page_id, toc)``; pages without headings get ''."""
        def build():
            line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), X.trim_ws(F.col("text")),
                            F.lit("](#"), F.col("slug"), F.lit(")"))
            t = ordered_concat(self.headings.withColumn("line", line), ["page_id"], "pos", "line", "\n", "toc")
            return self.corpus.page_info.select("page_id").join(t, "page_id", "left").select(
                "page_id", F.coalesce("toc", F.lit("")).alias("toc"))
        return self._memo("toc", build)

    # ------------------------------------------------------------ links
    @property
    def link_targets(self) -> DataFrame:
        """E2 without the text: ``(page_id, open_pos, end_pos, href_raw, href_clean)``."""
        def build():
            a = self.kept_elements.filter((F.col("tag") == "a")).withColumn("href_raw", attr("attrs", "href")).filter(
                F.col("href_raw").isNotNull())
            a = a.join(self.corpus.page_info.select("page_id", "url"), "page_id")
            # cut: notes, cells, links and the body read them
            return materialize(a.select("page_id", "open_pos", "end_pos", "href_raw", U.clean_href(F.col("href_raw"), F.col("url")).alias("href_clean")))
        return self._memo("link_targets", build)

    @property
    def links(self) -> DataFrame:
        """``(page_id, pos, href_raw, href_clean, text)`` for kept ``a[href]``."""
        def build():
            a = self.link_targets
            txt = self.cleaned_tokens.filter(F.col("kind") == "text").select("page_id", "pos", "text")
            owned = assign_owner(txt, a.select("page_id", "open_pos", "end_pos"), "a")
            at = ordered_concat(owned, ["page_id", "a_open"], "pos", "text").withColumnRenamed("a_open", "open_pos")
            a = a.join(at, ["page_id", "open_pos"], "left")
            return a.select("page_id", F.col("open_pos").alias("pos"), "href_raw", "href_clean", F.coalesce("text", F.lit("")).alias("text"))
        return self._memo("links", build)

    # ------------------------------------------------------------ metadata
    @property
    def page_meta(self) -> DataFrame:
        def build():
            e = self.elements
            title_el = e.filter(F.col("tag") == "title").select("page_id", "open_pos", "end_pos")
            first_title = title_el.withColumn("_rn", F.row_number().over(
                Window.partitionBy("page_id").orderBy("open_pos"))).filter("_rn = 1").drop("_rn")
            owned = self.corpus.texts.join(first_title, "page_id").filter("pos > open_pos AND pos < end_pos")  # one title a page
            tt = ordered_concat(owned, ["page_id"], "pos", "text", "", "title")
            meta = e.filter(F.col("tag") == "meta").select(
                "page_id", "open_pos", attr("attrs", "name").alias("name"), attr("attrs", "content").alias("content"))
            w = Window.partitionBy("page_id", "name").orderBy("open_pos")
            meta = meta.filter(F.col("name").isin("description", "author")).withColumn(
                "_rn", F.row_number().over(w)).filter("_rn = 1")
            mv = meta.groupBy("page_id").agg(
                F.max(F.when(F.col("name") == "description", F.coalesce("content", F.lit("")))).alias("description"),
                F.max(F.when(F.col("name") == "author", F.coalesce("content", F.lit("")))).alias("author"))
            p = self.corpus.page_info.select("page_id", "url")
            p = p.join(tt, "page_id", "left").join(mv, "page_id", "left")
            title = X.trim_ws(F.regexp_replace(F.coalesce("title", F.lit("")), r"[ \t\n\f\r]+", " "))
            return p.select("page_id", title.alias("title"), F.col("url").alias("source"),
                            F.coalesce("author", F.lit("")).alias("author"),
                            F.coalesce("description", F.lit("")).alias("description"))
        return self._memo("page_meta", build)

    # ------------------------------------------------------------ replacements
    @property
    def selector_survivors(self) -> DataFrame:
        """Content elements whose open tag survives the selector removals."""
        def build():
            opens = self.after_selectors.filter(F.col("kind").isin("open", "void", "raw")).select(
                "page_id", F.col("pos").alias("open_pos"))
            return materialize(self.content_elements.join(opens, ["page_id", "open_pos"], "left_semi"))
        return self._memo("selector_survivors", build)

    @property
    def images(self) -> DataFrame:
        """The images, written once for text in one line, figures and the body."""
        from ..operators.extract import images
        return self._memo("images", lambda: materialize(images(self)))

    @property
    def code_pages(self) -> tuple[DataFrame, DataFrame]:
        """Kept elements and cleaned tokens of the pages that hold a ``pre``, which all that concerns code is found in, in many readings."""
        return self._memo("code_pages", lambda: self.of_pages_with("pre", self.kept_elements, self.kept_elements, self.cleaned_tokens))

    @staticmethod
    def of_pages_with(tag: str, elements: DataFrame, *relations: DataFrame) -> tuple[DataFrame, ...]:
        """Rows of the relations on pages whose ``elements`` have the tag, written: what reads them often reads no other pages."""
        pages = materialize(elements.filter(F.col("tag") == tag).select("page_id").distinct())
        return tuple(materialize(r.join(pages, "page_id", "left_semi")) for r in relations)

    @property
    def code_widgets(self) -> DataFrame:
        """P10: the widgets of code figures, written once for the code and the body."""
        from ..operators.extract import code_widgets
        return self._memo("code_widgets", lambda: materialize(code_widgets(self)))

    @property
    def replacements(self) -> DataFrame:
        """Elements rendered as one Markdown fragment: media quotes (E4/A6),
        SVG descriptions (E5), fenced code (E8/R3), GFM tables (R6), images (E3).
        ``(page_id, open_pos, stop_pos, md, how)``; only elements still in the
        cleaned token stream count.
        """
        def build():
            from ..operators import extract as EX
            esc = X.escape_markdown_text
            tags = self.present_tags
            ready = []  # written, as other steps read them, too
            parts = []
            if tags & {"iframe", "video", "audio"}:
                parts.append(EX.media(self).select("page_id", F.col("pos").alias("open_pos"), F.concat(
                    F.lit("\n\n> "), esc(F.col("description")), F.lit("\n\n")).alias("md")))
            if "svg" in tags:
                parts.append(EX.svgs(self).select("page_id", F.col("pos").alias("open_pos"),
                                                  F.when(F.col("action") == "removed", F.lit("")).otherwise(
                                                      F.concat(F.lit("\n\n"), F.col("description"), F.lit("\n\n"))).alias("md")))
            if "pre" in tags:
                parts.append(EX.code_blocks(self, fenced_only=True).select("page_id", F.col("pos").alias("open_pos"), F.concat(
                    F.lit("\n\n"), F.col("markdown"), F.lit("\n\n")).alias("md"), F.lit("code").alias("how")))
                ready.append(self.code_widgets.select("page_id", "open_pos", F.lit("").alias("md")))
            if "table" in tags and self.opt.gfm:
                parts.append(EX.render_tables(EX.table_cells(self)).select(
                    "page_id", F.col("table_pos").alias("open_pos"),
                    F.concat(F.lit("\n\n"), F.col("markdown"), F.lit("\n\n")).alias("md")))
            if "img" in tags:
                imgs = self.images
                ready.append(imgs.select("page_id", F.col("pos").alias("open_pos"), F.col("markdown").alias("md")))
                if "figure" in tags:
                    parts.append(EX.figures(self, imgs).select("page_id", F.col("pos").alias("open_pos"),
                                                               F.col("markdown").alias("md")))
            if self.notes is not None:
                ready += [x.select("page_id", "open_pos", "md") for x in self.notes[:3]]
            r = None  # an empty relation to begin with would have no partitioning, and the union neither
            for x in [*map(materialize, parts), *ready]:
                x = x if "how" in x.columns else x.withColumn("how", F.lit(None).cast("string"))
                r = x if r is None else r.unionByName(x)
            if r is None:
                r = self.spark.createDataFrame([], "page_id long, open_pos int, md string, how string")
            kept = self.cleaned_tokens.filter(F.col("kind").isin("open", "void")).select(
                "page_id", F.col("pos").alias("open_pos"))
            r = r.join(kept, ["page_id", "open_pos"], "left_semi")
            r = r.join(self.content_elements.select("page_id", "open_pos", "stop_pos"), ["page_id", "open_pos"])
            return materialize(r)
        return self._memo("replacements", build)

    # Tags whose relations feed rendering; a conversion builds only the
    # sub-plans whose tags occur in the kept content (one small aggregate,
    # bounded by this list, decides).
    GATED_TAGS = ["iframe", "video", "audio", "svg", "pre", "table", "img", "figure", "a", "code", "input"]

    @property
    def present_tags(self) -> set:
        def build():
            rows = self.kept_elements.filter(F.col("tag").isin(*self.GATED_TAGS)).select("tag").distinct().collect()
            return {r.tag for r in rows}
        return self._memo("present_tags", build)

    @property
    def notes(self):
        """(reference fragments, definitions, emptied lists, appendix), or None
        when the kept content has no links at all."""
        def build():
            if "a" not in self.present_tags:
                return None
            from ..operators.footnotes import note_replacements
            r, d, lst, app = note_replacements(self)
            return r, d, lst, materialize(app)
        return self._memo("notes", build)

    @property
    def render_tokens(self) -> DataFrame:
        """Cleaned tokens without the insides of replaced elements."""
        def build():
            iv = self.replacements.select("page_id", (F.col("open_pos") + 1).alias("open_pos"), "stop_pos")
            return materialize(sweep_keep(self.cleaned_tokens, iv))  # cut: texts, elements and replacements read them
        return self._memo("render_tokens", build)

    # ------------------------------------------------------------ render
    def _render_elements(self) -> DataFrame:
        """Parts of element opens and closes."""
        opens = self.render_tokens.filter(F.col("kind").isin("open", "void", "raw")).select(
            "page_id", F.col("pos").alias("open_pos"))
        e = self.kept_elements.join(opens, ["page_id", "open_pos"], "left_semi").join(
            self.replacements.select("page_id", "open_pos"), ["page_id", "open_pos"], "left_anti")
        h = self.headings.select("page_id", F.col("pos").alias("open_pos"), F.col("id").alias("hid"))
        e = e.join(h, ["page_id", "open_pos"], "left")
        e = e.join(self._unwrapped_links(), ["page_id", "open_pos"], "left")
        e = e.join(self._list_items(), ["page_id", "open_pos"], "left")
        e = e.join(self._task_boxes(), ["page_id", "open_pos"], "left") if "input" in self.present_tags and self.opt.gfm \
            else e.withColumn("box", F.lit(None).cast("string"))
        tag = F.col("tag")
        e = self.element_texts(e)
        open_md, close_md = F.col("open_md"), F.col("close_md")
        marker = F.when(F.col("list_tag") == "ol", F.concat(F.col("ordinal").cast("string"), F.lit(".  "))).otherwise(F.lit("-   "))
        gap = F.when(tag == "li", 1).when(tag.isin(*BLOCK_TAGS), 2)
        is_list = tag.isin("ul", "ol")
        holder = F.when(tag == "blockquote", F.lit("> ")).when(tag == "li", F.lit("    "))
        mark = F.when(tag == "li", marker)
        pos, end = F.col("open_pos"), F.col("end_pos")
        zero, one = F.lit(0), F.lit(1)
        ends = F.col("ekind") == "open"
        return dealt(  # begins and ends of one relation, which is read once
            e, ["page_id"],
            _part(pos, one, zero, 0, brk=gap, nested=is_list),
            _part(pos, one, zero, 1, push=holder, marker=mark),
            _part(pos, one, zero, 2, md=open_md),
            _part(pos, one, zero, 3, brk=F.when(tag == "hr", 2)),
            _part(end, zero, -pos, 0, md=F.when(ends, close_md)),
            _part(end, zero, -pos, 1, pop=F.when(ends, F.length(holder))),
            _part(end, zero, -pos, 2, brk=F.when(ends, gap), nested=is_list)).filter(PART_SAYS)

    def element_texts(self, e: DataFrame) -> DataFrame:
        """Elements with ``hid``, ``unwrap`` and ``box`` -> also ``open_md`` and ``close_md``, by the rendering rules."""
        tags = self.present_tags
        nothing = F.lit(None).cast("string")
        e = e.join(self.link_targets.select("page_id", "open_pos", "href_clean"), ["page_id", "open_pos"], "left") \
            if "a" in tags else e.withColumn("href_clean", nothing)
        e = e.join(self.code_ticks, ["page_id", "open_pos"], "left") if "code" in tags else e.withColumn("ticks", nothing)
        title = F.coalesce(attr("attrs", "title"), F.lit(""))
        linked = U.safe_href(F.col("href_clean")).isNotNull() & F.col("unwrap").isNull()
        return written(e, self.render_rules, {
            "id": F.when(F.col("hid") != "", F.col("hid")),
            "link": F.when(linked, F.concat("href_clean", F.when(title != "", F.concat(F.lit(' "'), title, F.lit('"'))).otherwise(F.lit("")))),
            "ticks": F.when(F.col("tag") == "code", F.coalesce("ticks", F.lit("`"))),
            "box": F.col("box")})

    @staticmethod
    def written_out(df: DataFrame) -> DataFrame:
        """``df``, read from a checkpoint: a stage holds a sort for each window in it, and they share a task's memory."""
        return materialize(df)

    @property
    def inline_images(self) -> DataFrame:
        """``(page_id, open_pos, stop_pos, md)`` of images, for text in one line."""
        def build():
            if "img" not in self.present_tags:
                return self.spark.createDataFrame([], "page_id long, open_pos int, stop_pos int, md string")
            found = self.images.select("page_id", F.col("pos").alias("open_pos"), F.col("markdown").alias("md"))
            return materialize(self.content_elements.select("page_id", "open_pos", "stop_pos").join(found, ["page_id", "open_pos"]))
        return self._memo("inline_images", build)

    @property
    def render_rules(self) -> DataFrame:
        """H1, H2: the renderer's rules with those of the options."""
        def build():
            extra = self.opt.render_rules
            return render_rules(self.spark, self.opt.gfm, None if extra is None else taken_over(self.spark, extra))
        return self._memo("render_rules", build)

    @property
    def code_ticks(self) -> DataFrame:
        """Delimiters of code spans that hold backticks: the shortest run of them that the span doesn't hold, with a space
        where the span begins or ends with a backtick."""
        if "ticks" in self._cache:
            return self._cache["ticks"]
        spans = self.kept_elements.filter(F.col("tag") == "code").select("page_id", "open_pos", "end_pos")
        txt = self.cleaned_tokens.filter(F.col("kind") == "text").select("page_id", "pos", "text")
        t = ordered_concat(assign_owner(txt, spans, "c"), ["page_id", "c_open"], "pos", "text").filter(F.col("text").contains("`"))
        held = F.transform(F.regexp_extract_all("text", F.lit("`+"), 0), F.length)
        free = F.filter(F.sequence(F.lit(1), F.size(held) + 1), lambda n: ~F.array_contains(held, n))
        pad = F.when(F.col("text").startswith("`") | F.col("text").endswith("`"), F.lit(" ")).otherwise(F.lit(""))
        self._cache["ticks"] = materialize(t.select(
            "page_id", F.col("c_open").alias("open_pos"), F.concat(F.repeat(F.lit("`"), free[0]), pad).alias("ticks")))
        return self._cache["ticks"]

    def _task_boxes(self) -> DataFrame:
        """The state of each checkbox whose parent is a list item, ``x`` or a space."""
        from ..operators.extract import parent_of
        e = self.kept_elements
        box = e.filter((F.col("tag") == "input") & (F.lower(attr("attrs", "type")) == "checkbox")).select(
            "page_id", "open_pos", F.when(attr("attrs", "checked").isNotNull(), F.lit("x")).otherwise(F.lit(" ")).alias("box"))
        items = e.filter(F.col("tag") == "li").select("page_id", F.col("open_pos").alias("parent_open"))
        parents = parent_of(e.select("page_id", "open_pos", "stop_pos")).join(items, ["page_id", "parent_open"], "left_semi")
        return box.join(parents.select("page_id", "open_pos"), ["page_id", "open_pos"], "left_semi")

    def _unwrapped_links(self) -> DataFrame:
        """A heading whose only child element is a link renders the link's content only."""
        e = self.kept_elements
        pts = self.cleaned_tokens.select("page_id", "pos", F.when(F.col("kind").isin("open", "void"), 1).otherwise(0).alias("w_el"))
        spans = e.filter(F.col("tag").isin("a", *HEADINGS)).select("page_id", "open_pos", "end_pos")
        inner = materialize(interval_sums(pts, spans, ["w_el"]))
        h = e.filter(F.col("tag").isin(*HEADINGS)).join(inner, ["page_id", "open_pos"]).select(
            "page_id", "open_pos", "end_pos", F.col("w_el").alias("h_n"))
        a = e.filter(F.col("tag") == "a").join(inner, ["page_id", "open_pos"]).select(
            "page_id", F.col("open_pos").alias("pos"), F.col("w_el").alias("a_n"))
        owned = assign_owner(a, h.select("page_id", "open_pos", "end_pos"), "h")
        j = owned.join(h.select("page_id", F.col("open_pos").alias("h_open"), "h_n"), ["page_id", "h_open"])
        return j.filter(F.col("h_n") == F.col("a_n") + 1).select("page_id", F.col("pos").alias("open_pos"),
                                                                  F.lit(True).alias("unwrap"))

    def _list_items(self) -> DataFrame:
        """Tag of the innermost list and ordinal of each ``li``, from the list's ``start`` on."""
        e = self.kept_elements
        start = F.regexp_extract(F.coalesce(attr("attrs", "start"), F.lit("")), r"^\s*(\d+)", 1).try_cast("int")
        lists = e.filter(F.col("tag").isin("ul", "ol")).select(
            "page_id", "open_pos", "end_pos", F.col("tag").alias("list_tag"), F.coalesce(start, F.lit(1)).alias("start"))
        li = assign_owner(e.filter(F.col("tag") == "li").select("page_id", F.col("open_pos").alias("pos")), lists, "l")
        li = li.join(lists.select("page_id", F.col("open_pos").alias("l_open"), "list_tag", "start"), ["page_id", "l_open"])
        nth = F.row_number().over(Window.partitionBy("page_id", "l_open").orderBy("pos")) - 1
        return li.select("page_id", F.col("pos").alias("open_pos"), "list_tag", (F.col("start") + nth).alias("ordinal"))

    def _render_text(self) -> DataFrame:
        t = self.render_tokens
        blockish = (F.col("kind").isin("open", "close", "void") & F.col("tag").isin(*BLOCK_TAGS)) | F.col("kind").isin("raw")
        w = Window.partitionBy("page_id").orderBy("pos")
        before = F.col("_b") | F.coalesce(F.col("tag") == "input", F.lit(False))  # a box brings its own space
        t = t.withColumn("_b", blockish).withColumn("_prev_b", F.lag(before, 1, True).over(w)).withColumn(
            "_next_b", F.lead("_b", 1, True).over(w))

        def within(name):
            return F.sum(F.when((F.col("tag") == name) & (F.col("kind") == "open"), 1).when(
                (F.col("tag") == name) & (F.col("kind") == "close"), -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))

        t = t.withColumns({"_code": within("code"), "_pre": within("pre")})
        blank = ~F.col("text").rlike(f"[^{X.WS}]")
        t = t.filter((F.col("kind") == "text") & (~blank | ~(F.col("_prev_b") | F.col("_next_b"))))
        # no white space at the edges of a block, lines of a pre as they are, no escapes in inline code
        flat = X.collapse_inline_ws(F.col("text"))
        flat = F.when(F.col("_prev_b"), F.ltrim(flat)).otherwise(flat)
        flat = F.when(F.col("_next_b"), F.rtrim(flat)).otherwise(flat)
        lines = F.regexp_replace("text", r"\r\n?", "\n")
        lines = F.when(F.col("_prev_b"), F.regexp_replace(lines, r"^([ \t]*\n)+", "")).otherwise(lines)
        lines = F.when(F.col("_next_b"), F.regexp_replace(lines, r"(\n[ \t]*)+\z", "")).otherwise(lines)
        md = F.when(F.col("_pre") > 0, lines).otherwise(flat)
        plain = F.col("_code") <= 0
        md = F.when(plain, X.escape_markdown_text(md)).otherwise(md)
        # the text is computed once: a projection alone would be computed again by each condition on it
        t = dealt(t, ["page_id", "pos", "_code"], F.struct(md.alias("md"))).filter("md <> ''")
        part = _part(F.col("pos"), F.lit(1), F.lit(0), 0, md=F.col("md"), how=F.when(plain, F.lit("text")))
        return t.select("page_id", part.alias("f")).select("page_id", "f.*")

    def _render_replacements(self) -> DataFrame:
        """Replaced elements: blank lines at their edges are breaks, the rest is text."""
        live = self.render_tokens.filter(F.col("kind").isin("open", "void")).select(
            "page_id", F.col("pos").alias("open_pos"))
        repl = self.replacements.join(live, ["page_id", "open_pos"], "left_semi")  # not nested in another
        edge = F.when(F.col("md").startswith("\n\n"), 2)
        md, pos, one, zero = F.regexp_replace("md", r"^\n+|\n+$", ""), F.col("open_pos"), F.lit(1), F.lit(0)
        return dealt(repl.filter(F.col("md") != ""), ["page_id"], _part(pos, one, zero, 0, brk=edge),
                     _part(pos, one, zero, 2, md=md, how=F.col("how")), _part(pos, one, zero, 3, brk=edge)).filter(PART_SAYS)

    @staticmethod
    def _assembled(parts: DataFrame) -> DataFrame:
        """A4: texts with the breaks, prefixes and list markers that stand before them.

        Quotes and list items push a prefix that every line in them begins
        with. A text takes the widest break since the text before it; the
        blank line of a wide break has the shortest prefix in between. ``seg``
        counts the stretches of a page: even ones are Markdown, odd ones code.
        """
        key = ["k1", "k2", "k3", "k4"]
        events = parts.filter(F.col("push").isNotNull() | F.col("pop").isNotNull())
        steps = events.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*key, "push", "pop", "marker"))).alias("steps"))
        state = "struct<prefix:string,out:array<struct<k1:int,k2:int,k3:int,k4:int,marker:string,prefix:string>>>"

        def step(acc, x):
            prefix = F.when(x["push"].isNotNull(), F.concat(acc["prefix"], x["push"])).otherwise(
                F.substring(acc["prefix"], F.lit(1), F.greatest(F.length(acc["prefix"]) - x["pop"], F.lit(0))))
            row = F.struct(*[x[k].alias(k) for k in key], x["marker"].alias("marker"), prefix.alias("prefix"))
            return F.struct(prefix.alias("prefix"), F.concat(acc["out"], F.array(row)).alias("out")).cast(state)

        start = F.struct(F.lit("").alias("prefix"), F.array().alias("out")).cast(state)
        held = steps.select("page_id", F.explode(F.aggregate("steps", start, step)["out"]).alias("f")).select("page_id", "f.*")
        rows = parts.filter(F.col("push").isNull() & F.col("pop").isNull()).select("page_id", *key, "md", "brk", "nested", "how")
        nothing = {c: F.lit(None).cast(t) for c, t in (("md", "string"), ("brk", "int"), ("nested", "boolean"), ("how", "string"))}
        rows = rows.withColumns({"marker": F.lit(None).cast("string"), "prefix": F.lit(None).cast("string")})
        rows = rows.unionByName(held.withColumns(nothing))
        w = Window.partitionBy("page_id").orderBy(*key)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        text = F.col("md").isNotNull().cast("int")
        rows = rows.withColumn("prefix", F.coalesce(F.last("prefix", ignorenulls=True).over(so_far), F.lit("")))
        rows = rows.withColumn("n", F.sum(text).over(so_far) - text)
        last = F.last("md", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        code = F.coalesce(F.col("how") == "code", F.lit(False)).cast("int")
        rows = rows.withColumns({"_broken": F.coalesce(last.endswith("\n"), F.lit(True)), "seg": F.sum(code).over(so_far) * 2 - code})
        in_item = F.coalesce("nested", F.lit(False)) & F.col("prefix").endswith("    ")
        rows = rows.withColumn("brk", F.when(in_item, 1).otherwise(F.col("brk")))
        gap = Window.partitionBy("page_id", "n")
        rows = rows.withColumn("brk", F.coalesce(F.max("brk").over(gap), F.lit(0)))
        rows = rows.withColumn("low", F.min(F.struct(F.length("prefix").alias("l"), F.col("prefix").alias("p"))).over(gap)["p"])
        rows = rows.withColumn("marker", F.max(F.when(F.col("marker").isNotNull(), F.struct(*key, "marker"))).over(gap)["marker"])
        first = F.when(F.col("marker").isNotNull(), F.concat(
            F.substring("prefix", F.lit(1), F.length("prefix") - 4), F.col("marker"))).otherwise(F.col("prefix"))
        before = (F.when(F.col("n") == 0, first).when(F.col("brk") == 0, F.lit(""))
                  .when(F.col("brk") == 1, F.concat(F.lit("\n"), first))
                  .otherwise(F.concat(F.lit("\n"), F.rtrim("low"), F.lit("\n"), first)))
        at_start = (F.col("n") == 0) | (F.col("brk") > 0) | F.col("_broken")
        md = F.when(F.col("how") == "text", X.escape_line_starts(F.col("md"), at_start)).otherwise(F.col("md"))
        lines = F.split(md, "\n", -1)  # a blank line has no white space; the last one goes on with the next text
        follow = F.transform(lines, lambda line, i: F.when(i == 0, line).when(
            (line == "") & (i < F.size(lines) - 1), F.rtrim("prefix")).otherwise(F.concat("prefix", line)))
        md = F.concat(before, F.when(F.instr(md, "\n") > 0, F.array_join(follow, "\n")).otherwise(md))
        return rows.filter(F.col("md").isNotNull()).select("page_id", *key, "seg", md.alias("md"))

    @property
    def body(self) -> DataFrame:
        """A4: ordered aggregation of the fragments by chunk, stretch and page -> ``(page_id, body)``; F6 leaves code alone."""
        def build():
            parts = self._render_elements().unionByName(self._render_text()).unionByName(self._render_replacements())
            frags = self._assembled(materialize(parts))
            frags = frags.withColumn("chunk", F.floor(F.col("k1") / CHUNK).cast("int"))
            arr = F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "k4", "md")))
            part = frags.groupBy("page_id", "seg", "chunk").agg(F.array_join(F.transform(arr, lambda x: x["md"]), "").alias("md"))
            segs = ordered_concat(part, ["page_id", "seg"], "chunk", "md", "", "md")
            segs = segs.withColumn("md", F.when(F.col("seg") % 2 == 1, F.col("md")).otherwise(X.normalize_markdown("md")))
            whole = ordered_concat(segs, ["page_id"], "seg", "md", "", "raw_body")
            app = self.notes[3] if self.notes is not None else \
                self.spark.createDataFrame([], "page_id long, appendix string")
            b = self.corpus.page_info.select("page_id").join(whole, "page_id", "left").join(app, "page_id", "left")
            body = X.trim_ws(F.coalesce("raw_body", F.lit("")))
            # A5: the footnote appendix follows the post-processed body, unprocessed
            body = F.when(F.coalesce("appendix", F.lit("")) != "", F.concat(body, F.lit("\n\n"), F.col("appendix"))).otherwise(body)
            return b.select("page_id", body.alias("body"))
        return self._memo("body", build)

    @property
    def documents(self) -> DataFrame:
        """``(page_id, url, host, front_matter, toc, body, markdown)``."""
        def build():
            p = self.corpus.page_info
            m = self.page_meta
            d = p.join(m, "page_id").join(self.toc, "page_id").join(self.body, "page_id")
            if self.canonical is not None:  # canonical content wins, without a TOC
                d = d.join(self.canonical, "page_id", "left").select(
                    *[c for c in d.columns if c not in ("toc", "body")],
                    F.when(F.col("content").isNotNull(), F.lit("")).otherwise(F.col("toc")).alias("toc"),
                    F.coalesce("content", "body").alias("body"),
                    F.when(F.col("content").isNotNull(), F.lit("canonical")).otherwise(F.lit("converted")).alias("origin"))
            fm = X.build_front_matter(F.col("title"), F.col("source"), F.col("author"), F.col("description"),
                                      F.lit(self.opt.retrieved))
            d = d.withColumn("front_matter", fm)
            origin = F.col("origin") if "origin" in d.columns else F.lit("converted")
            return d.select("page_id", "url", "host", "front_matter", "toc", "body", origin.alias("origin"),
                            X.build_output(F.col("front_matter"), F.col("toc"), F.col("body")).alias("markdown"))
        return self._memo("documents", build)


def convert_pages(spark: SparkSession, pages: DataFrame, rules: DataFrame | None = None,
                  options: Options | None = None) -> DataFrame:
    return Conversion(spark, Corpus(spark, pages), rules, options).documents
