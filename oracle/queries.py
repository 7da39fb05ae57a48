"""DuckDB oracle SQL, one statement per registered query key.

Each statement starts from the driver's views (``pages``, ``part``, ...) and
re-states the operator in DuckDB SQL, sharing CTE text built in ``sqlfn``.
"""

from __future__ import annotations

from . import sqlfn as S
from .sqlfn import q

ORACLE: dict[str, str] = {}


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PAGES = ("pg AS (SELECT page_id, url, html, " + S.url_host("url") + " AS host FROM pages)")
TOK = S.tokens_cte("pg")
ELS = S.elements_cte()

ORACLE["scan_pages"] = with_(PAGES) + "SELECT page_id, url, host FROM pg"
ORACLE["tokens"] = with_(PAGES, TOK) + "SELECT page_id, pos, kind, tag, tok FROM tokens"
ORACLE["elements"] = with_(PAGES, TOK, ELS) + (
    "SELECT page_id, tag, open_pos, end_pos, stop_pos, explicit FROM elements")
ORACLE["element_attrs"] = with_(PAGES, TOK, ELS, S.attrs_cte()) + (
    "SELECT a.page_id, a.open_pos, e.tag, a.name, a.value FROM el_attrs a "
    "JOIN elements e USING (page_id, open_pos)")


# ---------------------------------------------------------------- conversion
from . import convert_sql as CV  # noqa: E402

_DOC = CV.documents_sql()

ORACLE["main_content"] = _DOC + "SELECT page_id, root_open, root_end FROM root"
ORACLE["remove_default"] = _DOC + "SELECT page_id, pos, kind, tag FROM t2"
ORACLE["subtree_removal"] = _DOC + "SELECT page_id, pos, kind, tag FROM kt"
ORACLE["text_content"] = _DOC + (
    "SELECT p.page_id, p.open_pos AS pos, string_agg(t.text, '' ORDER BY t.pos) AS text FROM ke p JOIN kt t "
    "ON t.page_id = p.page_id AND t.kind = 'text' AND t.pos > p.open_pos AND t.pos < p.end_pos "
    "WHERE p.tag = 'p' GROUP BY p.page_id, p.open_pos")
ORACLE["page_meta"] = _DOC + "SELECT page_id, title, source, author, description FROM page_meta"
ORACLE["links"] = _DOC + "SELECT page_id, pos, href_raw, href_clean, text FROM links"
ORACLE["headings"] = _DOC + "SELECT page_id, pos, level, text, id, slug FROM headings"
ORACLE["heading_slugs"] = _DOC + "SELECT page_id, pos, slug FROM headings"
ORACLE["toc"] = _DOC + "SELECT page_id, toc FROM toc"
ORACLE["convert_to_markdown"] = _DOC + "SELECT page_id, body AS markdown, toc FROM documents"
ORACLE["build_front_matter"] = _DOC + "SELECT page_id, front_matter FROM documents"
ORACLE["build_output"] = _DOC + f"SELECT page_id, {CV.output_expr()} AS markdown FROM documents"
ORACLE["convert_pages"] = _DOC + f"SELECT page_id, url, host, {CV.output_expr()} AS markdown FROM documents"

# ---------------------------------------------------------------- scalar functions
_TITLES = "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS input FROM pages"
_DOCS = "SELECT doc_id, text AS input FROM documents"
ORACLE["slugify"] = f"SELECT page_id, input, {S.slugify('input')} AS output FROM ({_TITLES})"
ORACLE["escape_yaml"] = f"SELECT doc_id, {S.escape_yaml('input')} AS output FROM ({_DOCS})"
ORACLE["escape_info_string"] = f"SELECT doc_id, {S.escape_info_string('input')} AS output FROM ({_DOCS})"
ORACLE["post_process_markdown"] = f"SELECT doc_id, {S.post_process_markdown('input')} AS output FROM ({_DOCS})"
ORACLE["squash_title"] = f"SELECT doc_id, {S.squash_ws('input')} AS output FROM ({_DOCS})"
ORACLE["escape_markdown_text"] = f"SELECT doc_id, {S.escape_markdown_text('input')} AS output FROM ({_DOCS})"
_FM = ("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'title: ' || lang || chr(10) || '---' || chr(10) || text "
       "WHEN 1 THEN '  ---' || chr(13) || chr(10) || 'title: x' || chr(13) || chr(10) || '  ---  ' || chr(13) || chr(10) || text "
       "WHEN 2 THEN '---' || chr(10) || 'title: ' || lang || chr(10) || 'No closing' || chr(10) || text ELSE text END AS input "
       "FROM documents")
_fm_f, _fm_c = S.strip_front_matter("input")
ORACLE["strip_front_matter"] = f"SELECT doc_id, {_fm_f} AS front_matter, {_fm_c} AS content FROM ({_FM})"
_TF = ("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(10) || '  ' || chr(10) || text || chr(10) || chr(9) || chr(10) "
       "WHEN 1 THEN chr(13) || chr(10) || text || chr(13) || chr(10) || chr(13) || chr(10) ELSE text END AS input FROM documents")
ORACLE["trim_fence_padding"] = f"SELECT doc_id, {S.trim_fence_padding('input')} AS output FROM ({_TF})"
_FNE = ("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE '' END AS a, "
        "CASE p_partkey % 4 WHEN 2 THEN '  ' || p_name || ' ' WHEN 3 THEN ' ' || chr(9) END AS b, "
        "CASE WHEN p_partkey % 4 <> 3 THEN p_brand END AS c FROM part")
ORACLE["first_non_empty"] = f"SELECT p_partkey, {S.first_non_empty('a', 'b', 'c')} AS output FROM ({_FNE})"
_FL = ("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' [' || p_size::VARCHAR || '] ' WHEN 1 THEN '[[' || p_brand || ']]' "
       "ELSE p_brand END AS input FROM part")
ORACLE["footnote_label"] = f"SELECT p_partkey, input, {S.footnote_label('input')} AS output FROM ({_FL})"
_IP = ("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR || 'px' WHEN 1 THEN ' -' || p_size::VARCHAR "
       "WHEN 2 THEN p_brand WHEN 3 THEN NULL ELSE p_size::VARCHAR || '.5' END AS input FROM part")
ORACLE["int_prefix"] = f"SELECT p_partkey, input, {S.int_prefix('input')} AS output FROM ({_IP})"
_SS = ("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a' || p_partkey::VARCHAR || '.jpg 320w, b' || p_partkey::VARCHAR || '.jpg ' || p_size::VARCHAR || '0w' "
       "WHEN 1 THEN 'n' || p_partkey::VARCHAR || '.jpg 1x, r' || p_partkey::VARCHAR || '.jpg 2x' "
       "WHEN 2 THEN 'only' || p_partkey::VARCHAR || '.jpg' WHEN 3 THEN ' , ' ELSE 'x.jpg 1.5x, y.jpg 150w, z.jpg' END AS input FROM part")
ORACLE["best_srcset"] = f"SELECT p_partkey, input, {S.best_srcset('input')} AS output FROM ({_SS})"
ORACLE["decode_entities"] = with_(PAGES, TOK) + (
    f"SELECT page_id, pos, {S.decode_entities('tok')} AS text FROM tokens WHERE kind = 'text' AND strpos(tok, '&') > 0")
ORACLE["retrieved_at"] = ("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS retrieved FROM orders")

# ---------------------------------------------------------------- URL functions
ORACLE["resolve_url"] = with_(PAGES, TOK, ELS, S.attrs_cte()) + (
    f"SELECT e.page_id, e.open_pos, a.value AS href, {S.resolve_url('a.value', 'p.url')} AS resolved FROM elements e "
    "JOIN pg p USING (page_id) LEFT JOIN el_attrs a ON a.page_id = e.page_id AND a.open_pos = e.open_pos AND a.name = 'href' "
    "WHERE e.tag = 'a'")
_UC = ("SELECT p_partkey, CASE p_partkey % 12 "
       "WHEN 0 THEN '../a/' || p_partkey::VARCHAR || '/./b' "
       "WHEN 1 THEN '//CDN.Example.COM:443/x/' || p_partkey::VARCHAR "
       "WHEN 2 THEN '?utm_source=x&id=' || p_partkey::VARCHAR || '&fbclid=z' "
       "WHEN 3 THEN '#fn' || p_partkey::VARCHAR WHEN 4 THEN '' "
       "WHEN 5 THEN 'HTTP://Www.Example.com:80/p q/' || p_partkey::VARCHAR || '?Ref=a&keep=1#frag' "
       "WHEN 6 THEN 'mailto:a' || p_partkey::VARCHAR || '@example.org' "
       "WHEN 7 THEN 'img/café-' || p_partkey::VARCHAR || '.png' "
       "WHEN 8 THEN 'https://example.com/?gclid=1&mc_cid=2&MC_EID=3' "
       "WHEN 9 THEN '/root/' || p_partkey::VARCHAR || '?a&&b=2&utm_medium=m' "
       "WHEN 10 THEN 'javascript:void(' || p_partkey::VARCHAR || ')' "
       "ELSE 'https://example.org:8080/x/' || p_partkey::VARCHAR || '/../y#a-' || p_partkey::VARCHAR END AS href, "
       "'https://site' || (p_partkey % 7)::VARCHAR || '.example.org/d/' || p_partkey::VARCHAR || '?q=1#top' AS base FROM part")
ORACLE["resolve_url_forms"] = f"SELECT p_partkey, href, {S.resolve_url('href', 'base')} AS resolved FROM ({_UC})"
ORACLE["strip_tracking"] = (
    f"SELECT p_partkey, href, {S.strip_tracking(S.resolve_url('href', 'base'))} AS output FROM ({_UC}) "
    f"UNION ALL SELECT page_id + 1000000000, url, {S.strip_tracking('url')} FROM pages")
ORACLE["url_provider"] = f"SELECT page_id, url, {S.url_provider('url')} AS provider FROM pages"
ORACLE["target_id"] = f"SELECT p_partkey, href, {S.target_id('href', 'base')} AS target_id FROM ({_UC})"
ORACLE["link_exempt"] = f"SELECT p_partkey, href, {S.clean_href('href', 'base')} AS href_clean FROM ({_UC})"


# ---------------------------------------------------------------- rule tables
_LOG = ("SELECT n_nationkey::BIGINT AS seq, CASE WHEN n_nationkey = 9 THEN 'reset' WHEN n_nationkey % 7 = 3 THEN 'delete' "
        "ELSE 'upsert' END AS op, CASE n_nationkey % 5 WHEN 0 THEN 'medium.com' WHEN 1 THEN 'site1.example.org' "
        "WHEN 2 THEN 'example.com' WHEN 3 THEN 'dev.to' ELSE lower(n_name) || '.example.org' END AS domain, "
        "CASE n_nationkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'main' ELSE '#content' END AS selector, "
        "CASE WHEN n_nationkey % 2 = 0 THEN ['.x-' || n_nationkey::VARCHAR, 'nav'] ELSE []::VARCHAR[] END AS remove FROM nation")
_BUILTIN = CV.builtin_rules_sql()


def _fold(log_where: str) -> str:
    return (
        f"WITH log AS (SELECT * FROM ({_LOG}) WHERE {log_where}), b AS ({_BUILTIN}), "
        "rs AS (SELECT max(seq) AS r FROM log WHERE op = 'reset'), "
        "live AS (SELECT * FROM log WHERE seq > coalesce((SELECT r FROM rs), -1) AND op <> 'reset'), "
        "lat AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq DESC) = 1), "
        "cu AS (SELECT domain, selector, remove FROM lat WHERE op = 'upsert'), "
        "eff AS (SELECT coalesce(cu.domain, b.domain) AS domain, CASE WHEN cu.domain IS NOT NULL THEN cu.selector ELSE b.selector END AS selector, "
        "CASE WHEN cu.domain IS NOT NULL THEN cu.remove ELSE b.remove END AS remove, "
        "CASE WHEN cu.domain IS NOT NULL THEN 'custom' ELSE 'builtin' END AS origin FROM b FULL OUTER JOIN cu ON b.domain = cu.domain) ")


ORACLE["rules_builtin"] = (
    f"SELECT b.domain, b.selector, array_to_string(b.remove, chr(10)) AS remove_list, count(p.host) AS pages FROM ({_BUILTIN}) b "
    f"LEFT JOIN (SELECT {S.url_host('url')} AS host FROM pages) p ON p.host = b.domain GROUP BY ALL")
ORACLE["rules_effective"] = _fold("true") + "SELECT domain, selector, array_to_string(remove, chr(10)) AS remove_list, origin FROM eff"
ORACLE["rules_upsert"] = _fold("op = 'upsert'") + "SELECT domain, selector, array_to_string(remove, chr(10)) AS remove_list, origin FROM eff"
ORACLE["rules_delete"] = _fold("op <> 'reset'") + "SELECT domain, selector, array_to_string(remove, chr(10)) AS remove_list, origin FROM eff"
ORACLE["rules_reset"] = _fold("true") + "SELECT domain, selector, array_to_string(remove, chr(10)) AS remove_list FROM eff WHERE origin = 'custom'"
ORACLE["rule_latest"] = (f"SELECT domain, seq, op FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq DESC) = 1")
ORACLE["rules_listing"] = _fold("true") + (
    "SELECT domain, selector, CASE WHEN coalesce(array_to_string(remove, ', '), '') = '' THEN '—' "
    "ELSE array_to_string(remove, ', ') END AS remove_list FROM eff")
_FORM = ("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '  ' ELSE '  ' || upper(n_name) || '.Example.org ' END AS domain, "
         "CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE ' article ' END AS selector, "
         "CASE n_nationkey % 3 WHEN 0 THEN ' .a' || chr(10) || chr(10) || '  .b ' || chr(10) WHEN 1 THEN '  ' || chr(10) || ' ' END AS remove FROM nation")
_lines = f"list_filter(list_transform(string_split(coalesce(remove, ''), chr(10)), lambda x: {S.trim_ws('x')}), lambda x: x <> '')"
ORACLE["rules_validate"] = (
    f"SELECT n_nationkey, lower({S.trim_ws('coalesce(domain, ' + q('') + ')')}) AS domain, "
    f"{S.trim_ws('coalesce(selector, ' + q('') + ')')} AS selector, "
    f"CASE WHEN len({_lines}) > 0 THEN array_to_string({_lines}, chr(10)) END AS remove_list, "
    f"CASE WHEN lower({S.trim_ws('coalesce(domain, ' + q('') + ')')}) <> '' AND {S.trim_ws('coalesce(selector, ' + q('') + ')')} <> '' "
    f"THEN 'ok' ELSE 'rejected' END AS status FROM ({_FORM})")
_SITE = ("SELECT domain, selector, remove FROM (" + _BUILTIN + ") UNION ALL SELECT DISTINCT " + S.url_host("url")
         + " AS domain, 'article' AS selector, ['b']::VARCHAR[] AS remove FROM pages WHERE url LIKE '%utm\\_%' ESCAPE '\\'")
ORACLE["page_rule_join"] = (
    f"WITH pg AS (SELECT page_id, {S.url_host('url')} AS host FROM pages), r AS ({_SITE}) "
    "SELECT pg.page_id, pg.host, r.domain, r.selector FROM pg LEFT JOIN r ON pg.host = r.domain")
_DOC_SITE = CV.documents_sql(rules_sql=_SITE)
ORACLE["remove_domain"] = _DOC_SITE + "SELECT page_id, pos, kind, tag FROM t2"
ORACLE["convert_pages_site_rules"] = _DOC_SITE + f"SELECT page_id, url, host, {CV.output_expr()} AS markdown FROM documents"

# ---------------------------------------------------------------- streaming, status, report
ORACLE["stream_convert"] = ORACLE["convert_pages"]
ORACLE["stream_rules"] = _fold("true") + "SELECT domain, selector, array_to_string(remove, chr(10)) AS remove_list FROM eff WHERE origin = 'custom'"
ORACLE["conversion_status"] = ("SELECT page_id, CASE WHEN coalesce(length(html), 0) = 0 THEN 'error' ELSE 'ok' END AS status, "
                               "CASE WHEN coalesce(length(html), 0) = 0 THEN 'page has no html' END AS error FROM pages")
ORACLE["run_report"] = _DOC + (
    f"SELECT d.host, 'converted' AS origin, CASE WHEN coalesce(length(p.html), 0) = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS pages, "
    f"sum(length({CV.output_expr()}))::BIGINT AS chars FROM documents d JOIN pages p USING (page_id) GROUP BY ALL")

# ---------------------------------------------------------------- fragment relations
from . import extract_sql as EX  # noqa: E402

ORACLE["images"] = EX.images_sql()
ORACLE["media"] = EX.media_sql()
ORACLE["svgs"] = EX.svgs_sql()
ORACLE["code_blocks"] = EX.code_sql()
ORACLE["sanitize"] = EX.sanitize_sql()
ORACLE["sql_functions"] = (f"SELECT doc_id, {S.slugify('lang')} AS slug, {S.escape_yaml('text')} AS yaml, {S.squash_ws('text')} AS title, "
                           f"{S.trim_fence_padding('text')} AS code FROM documents")
ORACLE["labelled_by_join"] = EX.labelled_by_sql()
ORACLE["code_widget_removal"] = EX.code_widget_removal_sql()
ORACLE["table_cells"] = EX.table_cells_sql()
ORACLE["render_table"] = EX.render_table_sql()

from .fragments_sql import fragment_sql  # noqa: E402

_FRAG_ALL = " UNION ALL ".join(
    f"SELECT page_id + {i * 1_000_000_000} AS page_id, url, html FROM ({fragment_sql(n)})"
    for i, n in enumerate(["frag_images", "frag_media", "frag_svg", "frag_code", "frag_tables", "frag_figures", "frag_notes"]))
ORACLE["render_fragments"] = CV.documents_sql(pages_sql=_FRAG_ALL) + "SELECT page_id, body AS markdown FROM body"

ORACLE["render_inline"] = CV.documents_sql(pages_sql=fragment_sql("frag_inline")) + "SELECT page_id, body AS markdown FROM body"

_DOC_HEADINGS = CV.documents_sql(pages_sql=fragment_sql("frag_headings"))
ORACLE["heading_fragments"] = _DOC_HEADINGS + "SELECT page_id, pos, level, text, id, slug FROM headings"
ORACLE["toc_fragments"] = _DOC_HEADINGS + "SELECT page_id, toc FROM toc"
ORACLE["link_fragments"] = CV.documents_sql(pages_sql=fragment_sql("frag_links")) + "SELECT page_id, pos, href_raw, href_clean, text FROM links"
ORACLE["meta_fragments"] = CV.documents_sql(pages_sql=fragment_sql("frag_meta")) + "SELECT page_id, title, source, author, description FROM page_meta"
ORACLE["noise_removal"] = CV.documents_sql(pages_sql=fragment_sql("frag_noise")) + "SELECT page_id, pos, kind, tag FROM kt"
ORACLE["block_fragments"] = CV.documents_sql(pages_sql=" UNION ALL ".join(
    f"SELECT page_id + {i * 1_000_000_000} AS page_id, url, html FROM ({fragment_sql(n)})"
    for i, n in enumerate(["frag_headings", "frag_quotes_lists", "frag_noise", "frag_links"]))) + "SELECT page_id, body AS markdown FROM body"
_ERROR_PAGES = ("SELECT page_id, url, CASE page_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE html END AS html "
                f"FROM ({fragment_sql('frag_errors')})")
_ERROR_RULES = ("SELECT DISTINCT 'site' || (s_suppkey % 7)::VARCHAR || '.example.org' AS domain, "
                "CASE s_suppkey % 7 WHEN 2 THEN 'main:first-child' ELSE 'article' END AS selector, "
                "CASE s_suppkey % 7 WHEN 1 THEN ['div > p', '.x'] WHEN 3 THEN ['[data-a=\"x,y\"]'] "
                "WHEN 4 THEN ['p:empty, div > p', 'a b'] ELSE []::VARCHAR[] END AS remove FROM supplier")
_BAD = ("(SELECT scope, string_agg(DISTINCT sel, ', ' ORDER BY sel) AS sels FROM (SELECT * FROM rs_a2 UNION ALL SELECT * FROM sr_a2) "
        "WHERE array_to_string(comps, '') <> sel GROUP BY scope)")
ORACLE["conversion_errors"] = CV.documents_sql(pages_sql=_ERROR_PAGES, rules_sql=_ERROR_RULES) + (
    "SELECT page_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, body FROM (SELECT d.page_id, d.body, "
    "CASE WHEN coalesce(p.html, '') = '' THEN 'page has no html' WHEN d.body = '' THEN 'page has no content' "
    f"WHEN b.sels IS NOT NULL THEN 'unsupported selector: ' || b.sels END AS error FROM documents d JOIN pg p USING (page_id) LEFT JOIN {_BAD} b ON b.scope = p.host)")

# ---------------------------------------------------------------- canonical path
_ALTS = ("SELECT 'https://site' || (s_suppkey % 7)::VARCHAR || '.example.org/' || CASE WHEN s_suppkey % 3 = 1 THEN 'd/md/' "
         "ELSE 'md/' END || s_suppkey::VARCHAR || '.md' AS url, CASE WHEN s_suppkey % 5 = 4 THEN 404 ELSE 200 END AS status, "
         "CASE s_suppkey % 4 WHEN 0 THEN '---' || chr(10) || 'title: Doc ' || s_suppkey::VARCHAR || chr(10) || '---' || chr(10) "
         "|| chr(10) || '# Doc ' || s_suppkey::VARCHAR || chr(10) || chr(10) || s_name || chr(10) "
         "WHEN 1 THEN '   ' || chr(10) || ' ' WHEN 2 THEN '---' || chr(10) || 'unclosed: ' || s_suppkey::VARCHAR || chr(10) || s_name "
         "ELSE '  # Plain ' || s_suppkey::VARCHAR || '  ' END AS text FROM supplier")
_DOC_ALT = CV.documents_sql(pages_sql=fragment_sql("frag_alternate"), alternates_sql=_ALTS)
ORACLE["canonical_link"] = _DOC_ALT + "SELECT page_id, href FROM canon_link"
ORACLE["canonical_join"] = _DOC_ALT + "SELECT page_id, content FROM canon"
ORACLE["canonical_pages_semi"] = _DOC_ALT + (
    "SELECT p.page_id, EXISTS (SELECT 1 FROM ct WHERE ct.page_id = p.page_id) AS converted FROM pg p")
ORACLE["convert_pages_canonical"] = _DOC_ALT + f"SELECT page_id, url, origin, {CV.output_expr()} AS markdown FROM documents"

ORACLE["figures"] = EX.figures_sql()
ORACLE["write_documents"] = ORACLE["convert_pages"]

ORACLE["main_content_scored"] = CV.documents_sql(pages_sql=fragment_sql("frag_plain")) + (
    "SELECT r.page_id, root_open, root_end, coalesce(sum(length(t.text)) FILTER (WHERE t.kind = 'text'), 0)::BIGINT AS chars "
    "FROM root r LEFT JOIN ct t USING (page_id) GROUP BY ALL")
_DOC_NOTES = CV.documents_sql(pages_sql=fragment_sql("frag_notes"))
ORACLE["footnote_refs"] = _DOC_NOTES + "SELECT page_id, phase, ref_pos, target, raw_label FROM fn_refs"
ORACLE["footnote_labels"] = _DOC_NOTES + "SELECT page_id, target, ord, label FROM fn_lab"
ORACLE["footnotes"] = _DOC_NOTES + ("SELECT l.page_id, l.ord, l.label, l.target, d.note FROM fn_lab l "
                                    "LEFT JOIN fn_def d ON d.page_id = l.page_id AND d.target = l.target")
ORACLE["footnote_appendix"] = _DOC_NOTES + "SELECT page_id, body AS markdown FROM body"
