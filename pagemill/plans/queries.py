"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Keys follow the operator inventory (S*, F*, P*, J*, A*, W*, E*, R*, G*).
Every query reads the given tables (or relations Spark derives from them).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens as T
from .corpus import Corpus

REGISTRY: dict = {}


def register(key):
    def deco(fn):
        REGISTRY[key] = fn
        return fn
    return deco


@register("scan_pages")
def q_scan_pages(spark, d):
    return Corpus.from_dir(spark, d).page_info.select("page_id", "url", "host")


@register("tokens")
def q_tokens(spark, d):
    return Corpus.from_dir(spark, d).tokens.drop("text")


@register("elements")
def q_elements(spark, d):
    return Corpus.from_dir(spark, d).elements.select(
        "page_id", "tag", "open_pos", "end_pos", "stop_pos", "explicit")


@register("element_attrs")
def q_element_attrs(spark, d):
    e = Corpus.from_dir(spark, d).elements_attrs
    return e.select("page_id", "open_pos", "tag", F.explode("attrs").alias("name", "value"))


# ---------------------------------------------------------------- conversion
def _conv(spark, d):
    from .convert import Conversion
    return Conversion(spark, Corpus.from_dir(spark, d))


@register("main_content")
def q_main_content(spark, d):
    """Content root per page (open/end position of the chosen element)."""
    return _conv(spark, d).root


@register("main_content_scored")
def q_main_content_scored(spark, d):
    """Content root by text score, on pages without a main element built from ``supplier``, and the text in it."""
    c = _frag(spark, d, "frag_plain")
    text = c.content_tokens.filter(F.col("kind") == "text").groupBy("page_id").agg(F.sum(F.length("text")).alias("chars"))
    return c.root.join(text, "page_id", "left").select("page_id", "root_open", "root_end", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))


@register("remove_default")
def q_remove_default(spark, d):
    """P1 (+P2): content tokens left after the selector removals."""
    return _conv(spark, d).after_selectors.select("page_id", "pos", "kind", "tag")


@register("subtree_removal")
def q_subtree_removal(spark, d):
    """Content tokens left after every removal sweep."""
    return _conv(spark, d).cleaned_tokens.select("page_id", "pos", "kind", "tag")


@register("text_content")
def q_text_content(spark, d):
    """A1: text of every kept paragraph, in document order."""
    from .intervals import assign_owner, ordered_concat
    c = _conv(spark, d)
    p = c.kept_elements.filter(F.col("tag") == "p").select("page_id", "open_pos", "end_pos")
    txt = c.cleaned_tokens.filter(F.col("kind") == "text").select("page_id", "pos", "text")
    owned = assign_owner(txt, p, "p")
    t = ordered_concat(owned, ["page_id", "p_open"], "pos", "text")
    return t.select("page_id", F.col("p_open").alias("pos"), "text")


@register("page_meta")
def q_page_meta(spark, d):
    return _conv(spark, d).page_meta


@register("links")
def q_links(spark, d):
    return _conv(spark, d).links


@register("headings")
def q_headings(spark, d):
    return _conv(spark, d).headings


@register("heading_slugs")
def q_heading_slugs(spark, d):
    return _conv(spark, d).headings.select("page_id", "pos", "slug")


@register("toc")
def q_toc(spark, d):
    return _conv(spark, d).toc


@register("convert_to_markdown")
def q_convert_to_markdown(spark, d):
    c = _conv(spark, d)
    return c.body.join(c.toc, "page_id").select("page_id", F.col("body").alias("markdown"), "toc")


@register("build_front_matter")
def q_build_front_matter(spark, d):
    return _conv(spark, d).documents.select("page_id", "front_matter")


@register("build_output")
def q_build_output(spark, d):
    return _conv(spark, d).documents.select("page_id", "markdown")


@register("convert_pages")
def q_convert_pages(spark, d):
    """R8 flagship: one Markdown document per page."""
    return _conv(spark, d).documents.select("page_id", "url", "host", "markdown")


# ---------------------------------------------------------------- scalar functions
from ..functions import text as X  # noqa: E402
from ..functions import urls as U  # noqa: E402
from ..sources.tables import table  # noqa: E402


def _titles(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    return p.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("input"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("input"))


@register("slugify")
def q_slugify(spark, d):
    return _titles(spark, d).select("page_id", "input", X.slugify("input").alias("output"))


@register("escape_yaml")
def q_escape_yaml(spark, d):
    return _docs(spark, d).select("doc_id", X.escape_yaml("input").alias("output"))


@register("escape_info_string")
def q_escape_info_string(spark, d):
    return _docs(spark, d).select("doc_id", X.escape_info_string("input").alias("output"))


@register("post_process_markdown")
def q_post_process(spark, d):
    return _docs(spark, d).select("doc_id", X.post_process_markdown("input").alias("output"))


@register("squash_title")
def q_squash_title(spark, d):
    return _docs(spark, d).select("doc_id", X.squash_ws("input").alias("output"))


@register("escape_markdown_text")
def q_escape_md(spark, d):
    return _docs(spark, d).select("doc_id", X.escape_markdown_text("input").alias("output"))


def _fm_inputs(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "text")
    k = F.col("doc_id") % 4
    inp = (F.when(k == 0, F.concat(F.lit("---\ntitle: "), F.col("lang"), F.lit("\n---\n"), F.col("text")))
           .when(k == 1, F.concat(F.lit("  ---\r\ntitle: x\r\n  ---  \r\n"), F.col("text")))
           .when(k == 2, F.concat(F.lit("---\ntitle: "), F.col("lang"), F.lit("\nNo closing\n"), F.col("text")))
           .otherwise(F.col("text")))
    return t.select("doc_id", inp.alias("input"))


@register("strip_front_matter")
def q_strip_front_matter(spark, d):
    r = _fm_inputs(spark, d).select("doc_id", X.strip_front_matter("input").alias("r"))
    return r.select("doc_id", "r.front_matter", "r.content")


@register("trim_fence_padding")
def q_trim_fence(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 3
    inp = (F.when(k == 0, F.concat(F.lit("\n  \n"), F.col("text"), F.lit("\n\t\n")))
           .when(k == 1, F.concat(F.lit("\r\n"), F.col("text"), F.lit("\r\n\r\n")))
           .otherwise(F.col("text")))
    return t.select("doc_id", X.trim_fence_padding(inp).alias("output"))


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@register("first_non_empty")
def q_first_non_empty(spark, d):
    p = _parts(spark, d)
    k = F.col("p_partkey") % 4
    a = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("   ")).otherwise(F.lit(""))
    b = F.when(k == 2, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).when(k == 3, F.lit(" \t"))
    c = F.when(k != 3, F.col("p_brand"))
    return p.select("p_partkey", X.first_non_empty(a, b, c).alias("output"))


@register("footnote_label")
def q_footnote_label(spark, d):
    p = _parts(spark, d)
    k = F.col("p_partkey") % 3
    inp = (F.when(k == 0, F.concat(F.lit(" ["), F.col("p_size").cast("string"), F.lit("] ")))
           .when(k == 1, F.concat(F.lit("[["), F.col("p_brand"), F.lit("]]")))
           .otherwise(F.col("p_brand")))
    return p.select("p_partkey", inp.alias("input"), X.footnote_label(inp).alias("output"))


@register("int_prefix")
def q_int_prefix(spark, d):
    p = _parts(spark, d)
    k = F.col("p_partkey") % 5
    inp = (F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit("px")))
           .when(k == 1, F.concat(F.lit(" -"), F.col("p_size").cast("string")))
           .when(k == 2, F.col("p_brand"))
           .when(k == 3, F.lit(None).cast("string"))
           .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5"))))
    return p.select("p_partkey", inp.alias("input"), X.int_prefix(inp).alias("output"))


@register("best_srcset")
def q_best_srcset(spark, d):
    p = _parts(spark, d)
    k = F.col("p_partkey") % 5
    s = F.col("p_size").cast("string")
    key = F.col("p_partkey").cast("string")
    inp = (F.when(k == 0, F.concat(F.lit("a"), key, F.lit(".jpg 320w, b"), key, F.lit(".jpg "), s, F.lit("0w")))
           .when(k == 1, F.concat(F.lit("n"), key, F.lit(".jpg 1x, r"), key, F.lit(".jpg 2x")))
           .when(k == 2, F.concat(F.lit("only"), key, F.lit(".jpg")))
           .when(k == 3, F.lit(" , "))
           .otherwise(F.concat(F.lit("x.jpg 1.5x, y.jpg 150w, z.jpg"))))
    return p.select("p_partkey", inp.alias("input"), X.best_srcset(inp).alias("output"))


@register("decode_entities")
def q_decode_entities(spark, d):
    t = Corpus.from_dir(spark, d).tokens.filter((F.col("kind") == "text") & (F.instr("tok", "&") > 0))
    return t.select("page_id", "pos", X.decode_entities(F.col("tok")).alias("text"))


@register("retrieved_at")
def q_retrieved_at(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return o.select("o_orderkey", X.retrieved_at("o_orderdate").alias("retrieved"))


# ---------------------------------------------------------------- URL functions
def _nav_hrefs(spark, d):
    c = Corpus.from_dir(spark, d)
    a = c.elements_attrs.filter(F.col("tag") == "a").select("page_id", "open_pos", T.attr("attrs", "href").alias("href"))
    return a.join(c.page_info.select("page_id", "url"), "page_id")


@register("resolve_url")
def q_resolve_url(spark, d):
    a = _nav_hrefs(spark, d)
    return a.select("page_id", "open_pos", "href", U.resolve_url(F.col("href"), F.col("url")).alias("resolved"))


def _url_cases(spark, d):
    """Relative/absolute URL forms built from part rows, resolved against a page-like base."""
    p = _parts(spark, d)
    k = F.col("p_partkey")
    key = k.cast("string")
    base = F.concat(F.lit("https://site"), (k % 7).cast("string"), F.lit(".example.org/d/"), key, F.lit("?q=1#top"))
    m = k % 12
    href = (F.when(m == 0, F.concat(F.lit("../a/"), key, F.lit("/./b")))
            .when(m == 1, F.concat(F.lit("//CDN.Example.COM:443/x/"), key))
            .when(m == 2, F.concat(F.lit("?utm_source=x&id="), key, F.lit("&fbclid=z")))
            .when(m == 3, F.concat(F.lit("#fn"), key))
            .when(m == 4, F.lit(""))
            .when(m == 5, F.concat(F.lit("HTTP://Www.Example.com:80/p q/"), key, F.lit("?Ref=a&keep=1#frag")))
            .when(m == 6, F.concat(F.lit("mailto:a"), key, F.lit("@example.org")))
            .when(m == 7, F.concat(F.lit("img/café-"), key, F.lit(".png")))
            .when(m == 8, F.concat(F.lit("https://example.com/?gclid=1&mc_cid=2&MC_EID=3")))
            .when(m == 9, F.concat(F.lit("/root/"), key, F.lit("?a&&b=2&utm_medium=m")))
            .when(m == 10, F.concat(F.lit("javascript:void("), key, F.lit(")")))
            .otherwise(F.concat(F.lit("https://example.org:8080/x/"), key, F.lit("/../y#a-"), key)))
    return p.select("p_partkey", href.alias("href"), base.alias("base"))


@register("resolve_url_forms")
def q_resolve_url_forms(spark, d):
    c = _url_cases(spark, d)
    return c.select("p_partkey", "href", U.resolve_url(F.col("href"), F.col("base")).alias("resolved"))


@register("strip_tracking")
def q_strip_tracking(spark, d):
    c = _url_cases(spark, d)
    r = U.resolve_url(F.col("href"), F.col("base"))
    pg = table(spark, d, "pages").select(F.col("page_id").alias("p_partkey"), F.col("url").alias("href"),
                                          U.strip_tracking(F.col("url")).alias("output"))
    return c.select("p_partkey", "href", U.strip_tracking(r).alias("output")).unionByName(
        pg.select(F.col("p_partkey") + 1000000000, "href", "output").toDF("p_partkey", "href", "output"))


@register("url_provider")
def q_url_provider(spark, d):
    pg = table(spark, d, "pages").select("page_id", "url")
    return pg.select("page_id", "url", U.url_provider(F.col("url")).alias("provider"))


@register("target_id")
def q_target_id(spark, d):
    c = _url_cases(spark, d)
    return c.select("p_partkey", "href", U.target_id(F.col("href"), F.col("base")).alias("target_id"))


@register("link_exempt")
def q_link_exempt(spark, d):
    """Empty, javascript: and #fragment links keep their href; others are cleaned."""
    c = _url_cases(spark, d)
    return c.select("p_partkey", "href", U.clean_href(F.col("href"), F.col("base")).alias("href_clean"))


# ---------------------------------------------------------------- rule tables
from ..sources import rules as RL  # noqa: E402


def rule_log(spark, d):
    """Rule edit log derived from ``nation``: upserts, overwrites, deletes (also
    of a built-in domain) and one reset, in ``seq`` order."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    op = F.when(k == 9, F.lit("reset")).when(k % 7 == 3, F.lit("delete")).otherwise(F.lit("upsert"))
    domain = (F.when(k % 5 == 0, F.lit("medium.com")).when(k % 5 == 1, F.lit("site1.example.org"))
              .when(k % 5 == 2, F.lit("example.com")).when(k % 5 == 3, F.lit("dev.to"))
              .otherwise(F.concat(F.lower("n_name"), F.lit(".example.org"))))
    selector = F.when(k % 3 == 0, F.lit("article")).when(k % 3 == 1, F.lit("main")).otherwise(F.lit("#content"))
    remove = F.when(k % 2 == 0, F.array(F.concat(F.lit(".x-"), k.cast("string")), F.lit("nav"))).otherwise(
        F.array().cast("array<string>"))
    return n.select(k.cast("long").alias("seq"), op.alias("op"), domain.alias("domain"), selector.alias("selector"),
                    remove.alias("remove"))


def _rm_list(c="remove"):
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "\n")


def site_rules(spark, d):
    """Per-site rules for the hosts of tracked (``utm_*``) page URLs: content in
    ``article``, bold text removed."""
    p = table(spark, d, "pages").select("url").filter(F.col("url").contains("utm_"))
    return p.select(U.url_host(F.col("url")).alias("domain")).distinct().select(
        "domain", F.lit("article").alias("selector"), F.array(F.lit("b")).alias("remove"))


@register("rules_builtin")
def q_rules_builtin(spark, d):
    """The built-in rules, each with the number of crawled pages of its host."""
    hosts = table(spark, d, "pages").groupBy(U.url_host(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))
    return RL.builtin_rules(spark).join(hosts, "domain", "left").select(
        "domain", "selector", _rm_list().alias("remove_list"), F.coalesce("pages", F.lit(0)).alias("pages"))


@register("rules_effective")
def q_rules_effective(spark, d):
    r = RL.fold_rules(RL.builtin_rules(spark), rule_log(spark, d))
    return r.select("domain", "selector", _rm_list().alias("remove_list"), "origin")


@register("rules_upsert")
def q_rules_upsert(spark, d):
    log = rule_log(spark, d).filter(F.col("op") == "upsert")
    r = RL.fold_rules(RL.builtin_rules(spark), log)
    return r.select("domain", "selector", _rm_list().alias("remove_list"), "origin")


@register("rules_delete")
def q_rules_delete(spark, d):
    log = rule_log(spark, d).filter(F.col("op") != "reset")
    r = RL.fold_rules(RL.builtin_rules(spark), log)
    return r.select("domain", "selector", _rm_list().alias("remove_list"), "origin")


@register("rules_reset")
def q_rules_reset(spark, d):
    r = RL.fold_rules(RL.builtin_rules(spark), rule_log(spark, d)).filter(F.col("origin") == "custom")
    return r.select("domain", "selector", _rm_list().alias("remove_list"))


@register("rule_latest")
def q_rule_latest(spark, d):
    log = rule_log(spark, d)
    return log.groupBy("domain").agg(F.max_by(F.struct("seq", "op"), "seq").alias("ev")).select(
        "domain", F.col("ev.seq").alias("seq"), F.col("ev.op").alias("op"))


def rule_form(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    domain = F.when(k % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.upper("n_name"), F.lit(".Example.org ")))
    selector = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(" article "))
    remove = F.when(k % 3 == 0, F.lit(" .a\n\n  .b \n")).when(k % 3 == 1, F.lit("  \n ")).otherwise(F.lit(None).cast("string"))
    return n.select(k.alias("n_nationkey"), domain.alias("domain"), selector.alias("selector"), remove.alias("remove"))


@register("rules_validate")
def q_rules_validate(spark, d):
    """S10 on form rows built from ``nation`` (blank domains/selectors, padded lines)."""
    f = rule_form(spark, d)
    v = RL.validate_rule_form(f)
    return v.select("n_nationkey", "domain", "selector", F.array_join("remove", "\n").alias("remove_list"), "status")


@register("rules_listing")
def q_rules_listing(spark, d):
    r = RL.fold_rules(RL.builtin_rules(spark), rule_log(spark, d))
    return RL.rules_listing(r)


@register("page_rule_join")
def q_page_rule_join(spark, d):
    c = Corpus.from_dir(spark, d)
    rules = RL.builtin_rules(spark).unionByName(site_rules(spark, d))
    j = RL.page_rule_join(c.page_info, rules)
    return j.select("page_id", "host", "domain", "selector")


@register("remove_domain")
def q_remove_domain(spark, d):
    """Per-site removals (site rules for tracked-URL hosts remove ``b``)."""
    from .convert import Conversion
    rules = RL.builtin_rules(spark).unionByName(site_rules(spark, d))
    c = Conversion(spark, Corpus.from_dir(spark, d), rules)
    return c.after_selectors.select("page_id", "pos", "kind", "tag")


@register("convert_pages_site_rules")
def q_convert_pages_site_rules(spark, d):
    """R8 with per-site rules joined in (J1 + P2 + site selector root)."""
    from .convert import Conversion
    rules = RL.builtin_rules(spark).unionByName(site_rules(spark, d))
    c = Conversion(spark, Corpus.from_dir(spark, d), rules)
    return c.documents.select("page_id", "url", "host", "markdown")


# ---------------------------------------------------------------- streaming, status, report
def _scratch(spark, name):
    import uuid

    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@register("stream_convert")
def q_stream_convert(spark, d):
    """G1: the pages file consumed as a stream (availableNow), converted per
    micro-batch; the appended output must equal the batch ``convert_pages``."""
    from ..streaming.stream import stream_convert
    out, ck = _scratch(spark, "stream-out"), _scratch(spark, "stream-ck")
    q = stream_convert(spark, f"{d.rstrip('/')}/pages*.parquet", out, ck)
    q.awaitTermination()
    return spark.read.parquet(out).select("page_id", "url", "host", "markdown")


@register("stream_rules")
def q_stream_rules(spark, d):
    """The nation-derived rule log consumed as a stream and folded into the
    custom-rule table; equals the batch fold's custom rows."""
    from ..streaming.stream import custom_rules, stream_rules
    log_dir, custom, ck = _scratch(spark, "rule-log"), _scratch(spark, "rules"), _scratch(spark, "rules-ck")
    log = rule_log(spark, d)
    log.write.parquet(log_dir)
    q = stream_rules(spark, log_dir, custom, ck, log.schema)
    q.awaitTermination()
    return custom_rules(spark, custom).select("domain", "selector", _rm_list().alias("remove_list"))


@register("conversion_status")
def q_conversion_status(spark, d):
    """Per-page status and error message."""
    from ..streaming.stream import convert_batch
    pages = table(spark, d, "pages")
    return convert_batch(spark, pages).select("page_id", "status", "error")


@register("run_report")
def q_run_report(spark, d):
    """Pages and Markdown characters per host, origin and status (partial
    aggregation before the shuffle, so a hot host is pre-aggregated)."""
    from ..streaming.stream import convert_batch
    docs = convert_batch(spark, table(spark, d, "pages"))
    return docs.groupBy("host", "origin", "status").agg(F.count("*").alias("pages"),
                                             F.sum(F.length("markdown")).cast("long").alias("chars"))


# ---------------------------------------------------------------- fragment relations
def _frag(spark, d, name):
    from ..sources.fragments import fragment_pages
    from .convert import Conversion
    pages = fragment_pages(spark, d, name).withColumn("host", U.url_host(F.col("url")))
    return Conversion(spark, Corpus(spark, pages))


@register("images")
def q_images(spark, d):
    """E3 + P6 + P12 + J4 + F2 on image fragments built from ``part``."""
    from ..operators.extract import images
    return images(_frag(spark, d, "frag_images"))


@register("media")
def q_media(spark, d):
    """E4 + A6 + J5 + F11 on media fragments built from ``part``."""
    from ..operators.extract import media
    return media(_frag(spark, d, "frag_media"))


@register("svgs")
def q_svgs(spark, d):
    """E5 / P7 on SVG fragments built from ``part``."""
    from ..operators.extract import svgs
    return svgs(_frag(spark, d, "frag_svg"))


@register("code_blocks")
def q_code_blocks(spark, d):
    """E8 + F14 + F16 + J6 + J7 + R3 on code fragments built from ``part``."""
    from ..operators.extract import code_blocks
    return code_blocks(_frag(spark, d, "frag_code"))


@register("sanitize")
def q_sanitize(spark, d):
    """Allowed elements and attributes of fragments with handlers, unsafe links and foreign tags."""
    from ..operators.sanitize import sanitize
    s = sanitize(_frag(spark, d, "frag_sanitize").elements)
    return s.select("page_id", "open_pos", "tag", F.explode_outer("attrs").alias("name", "value"))


@register("sql_functions")
def q_sql_functions(spark, d):
    """H5: string functions called from SQL."""
    from ..functions.sql import register_functions
    register_functions(spark)
    return spark.sql("SELECT doc_id, slugify(lang) AS slug, escape_yaml(text) AS yaml, squash_title(text) AS title, "
                     "trim_fence_padding(text) AS code FROM {docs}", docs=table(spark, d, "documents"))


@register("labelled_by_join")
def q_labelled_by(spark, d):
    """Labels of code figures, found by id anywhere in the page."""
    from ..operators.extract import labelled_by
    return labelled_by(_frag(spark, d, "frag_code"))


@register("code_widget_removal")
def q_code_widget_removal(spark, d):
    """P10 + X1: tokens left of the code fragments when the widgets of code figures are gone."""
    from ..operators.extract import code_widgets
    from .intervals import sweep_keep
    c = _frag(spark, d, "frag_code")
    return sweep_keep(c.cleaned_tokens, code_widgets(c)).select("page_id", "pos", "kind", "tag")


@register("table_cells")
def q_table_cells(spark, d):
    """E11 on table fragments built from ``supplier``."""
    from ..operators.extract import table_cells
    return table_cells(_frag(spark, d, "frag_tables"))


@register("render_table")
def q_render_table(spark, d):
    """GFM text of each table."""
    from ..operators.extract import render_tables, table_cells
    return render_tables(table_cells(_frag(spark, d, "frag_tables")))


FRAGMENT_VIEWS = ["frag_images", "frag_media", "frag_svg", "frag_code", "frag_tables", "frag_figures", "frag_notes"]
BLOCK_VIEWS = ["frag_headings", "frag_quotes_lists", "frag_noise", "frag_links"]


def _frags(spark, d, views):
    """One conversion of several fragment views, ``page_id`` offset by view."""
    from ..sources.fragments import fragment_pages
    from .convert import Conversion
    pages = None
    for i, name in enumerate(views):
        p = fragment_pages(spark, d, name).withColumn("page_id", F.col("page_id") + F.lit(i * 1_000_000_000))
        pages = p if pages is None else pages.unionByName(p)
    return Conversion(spark, Corpus(spark, pages.withColumn("host", U.url_host(F.col("url")))))


@register("render_fragments")
def q_render_fragments(spark, d):
    """R1-R7 on all fragment views together: Markdown body with media quotes,
    SVG descriptions, fenced code, GFM tables and images (page_id offset by view)."""
    return _frags(spark, d, FRAGMENT_VIEWS).body.select("page_id", F.col("body").alias("markdown"))


@register("render_inline")
def q_render_inline(spark, d):
    """Line starts, code spans, struck text, task boxes, code and preformatted text as Markdown."""
    return _frag(spark, d, "frag_inline").body.select("page_id", F.col("body").alias("markdown"))


@register("heading_fragments")
def q_heading_fragments(spark, d):
    """E6 + W1: repeated, named, linked and empty headings."""
    return _frag(spark, d, "frag_headings").headings


@register("toc_fragments")
def q_toc_fragments(spark, d):
    """A2 on heading fragments."""
    return _frag(spark, d, "frag_headings").toc


@register("link_fragments")
def q_link_fragments(spark, d):
    """E2 + F9 + F10: tracked, relative, unsafe and empty links."""
    return _frag(spark, d, "frag_links").links


@register("meta_fragments")
def q_meta_fragments(spark, d):
    """Titles, descriptions and authors, missing, empty or given twice."""
    return _frag(spark, d, "frag_meta").page_meta


@register("noise_removal")
def q_noise_removal(spark, d):
    """P1 + P3 + P4 + P5 + P9 + X1: tokens left of fragments with an element for each fixed selector, hidden and empty ones."""
    return _frag(spark, d, "frag_noise").cleaned_tokens.select("page_id", "pos", "kind", "tag")


@register("block_fragments")
def q_block_fragments(spark, d):
    """Headings, quotes, lists, task boxes and links as Markdown."""
    return _frags(spark, d, BLOCK_VIEWS).body.select("page_id", F.col("body").alias("markdown"))


def error_pages(spark, d):
    """``frag_errors``, some pages without html, and the rules of their sites, some with unsupported selectors."""
    from ..sources.fragments import fragment_pages
    html = F.when(F.col("page_id") % 11 == 0, F.lit(None)).when(F.col("page_id") % 11 == 1, "").otherwise(F.col("html"))
    pages = fragment_pages(spark, d, "frag_errors").withColumn("html", html)
    n = F.col("n")
    remove = (F.when(n == 1, F.array(F.lit("div > p"), F.lit(".x"))).when(n == 3, F.array(F.lit('[data-a="x,y"]')))
              .when(n == 4, F.array(F.lit("p:empty, div > p"), F.lit("a b"))).otherwise(F.array().cast("array<string>")))
    rules = table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("n")).distinct().select(
        F.concat(F.lit("site"), n.cast("string"), F.lit(".example.org")).alias("domain"),
        F.when(n == 2, "main:first-child").otherwise("article").alias("selector"), remove.alias("remove"))
    return pages, rules


@register("conversion_errors")
def q_conversion_errors(spark, d):
    """G3 + P3: pages without html or content, and those whose site's rule has unsupported selectors."""
    from ..streaming.stream import convert_batch
    pages, rules = error_pages(spark, d)
    return convert_batch(spark, pages, rules).select("page_id", "status", "error", "body")


# ---------------------------------------------------------------- canonical path
def _alt_conv(spark, d):
    from ..sources.canonical import crawled_alternates
    from ..sources.fragments import fragment_pages
    from .convert import Conversion
    pages = fragment_pages(spark, d, "frag_alternate").withColumn("host", U.url_host(F.col("url")))
    return Conversion(spark, Corpus(spark, pages), alternates=crawled_alternates(spark, d))


@register("canonical_link")
def q_canonical_link(spark, d):
    """First Markdown alternate link per page, resolved."""
    from ..sources.canonical import canonical_link
    return canonical_link(_alt_conv(spark, d).given.pages)


@register("canonical_join")
def q_canonical_join(spark, d):
    """S13 + F7: usable alternate content per page."""
    return _alt_conv(spark, d).canonical


@register("canonical_pages_semi")
def q_canonical_pages_semi(spark, d):
    """Pages that skip conversion (content tokens exist only for the others)."""
    c = _alt_conv(spark, d)
    converted = c.content_tokens.select("page_id").distinct().withColumn("converted", F.lit(True))
    return c.corpus.page_info.select("page_id").join(converted, "page_id", "left").select(
        "page_id", F.coalesce("converted", F.lit(False)).alias("converted"))


@register("convert_pages_canonical")
def q_convert_pages_canonical(spark, d):
    """R8 with published Markdown alternates joined in."""
    return _alt_conv(spark, d).documents.select("page_id", "url", "origin", "markdown")


@register("figures")
def q_figures(spark, d):
    """E10 + J8 on figure fragments built from ``part``."""
    from ..operators.extract import figures
    return figures(_frag(spark, d, "frag_figures"))


@register("write_documents")
def q_write_documents(spark, d):
    """Documents written as parquet by host bucket, read back."""
    from ..sources.sink import write_documents
    out = _scratch(spark, "documents")
    docs = _conv(spark, d).documents.select("page_id", "url", "host", "markdown")
    write_documents(docs, out)
    return spark.read.parquet(out).select("page_id", "url", "host", "markdown")


# ---------------------------------------------------------------- footnotes
@register("footnote_refs")
def q_footnote_refs(spark, d):
    """U3 + F12 + F13: note references in processing order."""
    from ..operators.footnotes import references
    return references(_frag(spark, d, "frag_notes")).select("page_id", "phase", "ref_pos", "target", "raw_label")


@register("footnote_labels")
def q_footnote_labels(spark, d):
    """Labels by first reference, with clash fallback to numbers."""
    from ..operators.footnotes import labels, references
    return labels(references(_frag(spark, d, "frag_notes")))


@register("footnotes")
def q_footnotes(spark, d):
    """E9 + J2 + P11: labelled notes with their definition text."""
    from ..operators.footnotes import definitions, labels, references
    c = _frag(spark, d, "frag_notes")
    labs = labels(references(c))
    defs = definitions(c, labs)
    return labs.join(defs.select("page_id", "target", "note"), ["page_id", "target"], "left").select(
        "page_id", "ord", "label", "target", "note")


@register("footnote_appendix")
def q_footnote_appendix(spark, d):
    """A3 + A5 + P13: Markdown body with references, notes appendix, definitions removed."""
    c = _frag(spark, d, "frag_notes")
    return c.body.select("page_id", F.col("body").alias("markdown"))
