"""DuckDB oracle for the conversion pipeline (root, cleaning, headings, links,
metadata, rendering). Containment is written directly (``NOT EXISTS`` /
range joins) rather than as sweeps, so the oracle is an independent
statement of the same semantics.
"""

from __future__ import annotations

from pagemill.functions.text import WS
from pagemill.operators.clean import EMPTY_EXEMPT, MEDIA_CONTENT_TAGS, MEDIA_TAGS, REPLACED_TAGS
from pagemill.operators.select import ALTERNATIVE_RE, ATTR_SEL_RE, COMP_RE, DEFAULT_REMOVE_SELECTORS, OPS
from pagemill.operators.sanitize import DROPPED_WITH_CONTENT
from pagemill.operators.tokens import BLOCK_TAGS
from pagemill.plans.convert import ROOT_FALLBACK
from pagemill.sources.rules import BUILTIN_RULES

from . import sqlfn as S
from .sqlfn import inlist, q

ATTR_NAMES = ["id", "class", "href", "title", "style", "hidden", "aria-hidden", "width", "height", "name",
              "content", "src", "alt", "srcset", "type", "rel", "role", "data-src", "data-original", "data-lazy-src",
              "data-src-large", "data-image-src", "data-srcset", "data-lazy-srcset", "data-original-srcset", "data-url",
              "aria-label", "data-title", "data-language", "data-lang", "lang", "data-rehype-pretty-code-figure",
              "data-rehype-pretty-code-title", "data-footnote-ref", "aria-labelledby", "aria-selected", "data-demo", "data-selected", "start", "checked"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def col(name: str) -> str:
    return "a_" + name.replace("-", "_")


def base_ctes(pages_sql: str = "SELECT page_id, url, html FROM pages", rules_sql: str | None = None) -> list[str]:
    rules_sql = rules_sql or builtin_rules_sql()
    pivot = ", ".join(f"max(value) FILTER (WHERE name = {q(n)}) AS {col(n)}" for n in ATTR_NAMES)
    return [
        f"pg AS (SELECT page_id, url, html, {S.url_host('url')} AS host FROM ({pages_sql}))",
        S.tokens_cte("pg"),
        S.elements_cte(),
        S.attrs_cte(),
        f"ap AS (SELECT page_id, open_pos, {pivot} FROM el_attrs GROUP BY page_id, open_pos)",
        "ee AS (SELECT e.*, p.host, ap.* EXCLUDE (page_id, open_pos) FROM elements e JOIN pg p USING (page_id) "
        "LEFT JOIN ap USING (page_id, open_pos))",
        f"tx AS (SELECT page_id, pos, kind, tag, tok, CASE WHEN kind = 'text' THEN {S.decode_entities('tok')} END AS text FROM tokens)",
        f"rules AS ({rules_sql})",
    ]


def builtin_rules_sql() -> str:
    rows = []
    for d, s, rm in BUILTIN_RULES:
        rows.append(f"({q(d)}, {q(s)}, [{', '.join(q(x) for x in rm)}]::VARCHAR[])")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(domain, selector, remove)"


def selector_ctes(prefix: str, rules_src: str) -> list[str]:
    """Parse ``rules_src(scope, rule_ord, selector)`` into ``{prefix}_conds``."""
    comp = "comp"
    aname = f"lower({S.rx(comp, ATTR_SEL_RE, 1)})"
    aop = S.rx(comp, ATTR_SEL_RE, 2)
    aval = f"({S.rx(comp, ATTR_SEL_RE, 3)} || {S.rx(comp, ATTR_SEL_RE, 4)} || {S.rx(comp, ATTR_SEL_RE, 5)})"
    op_name = "CASE WHEN " + aop + " = '' THEN 'exists' " + " ".join(
        f"WHEN {aop} = {q(k)} THEN {q(v)}" for k, v in OPS.items()) + " END"
    key = (f"CASE WHEN comp = '*' THEN 'tag' WHEN comp LIKE '.%' THEN '.' WHEN comp LIKE '#%' THEN '@id' "
           f"WHEN comp LIKE '[%' THEN '@' || {aname} ELSE 'tag' END")
    op = (f"CASE WHEN comp = '*' THEN 'any' WHEN comp LIKE '.%' OR comp LIKE '#%' THEN 'eq' "
          f"WHEN comp LIKE '[%' THEN {op_name} ELSE 'eq' END")
    value = (f"CASE WHEN comp LIKE '.%' OR comp LIKE '#%' THEN substr(comp, 2) WHEN comp LIKE '[%' THEN {aval} "
             f"WHEN comp = '*' THEN NULL ELSE lower(comp) END")
    p = prefix
    return [
        f"{p}_a0 AS (SELECT scope, rule_ord, generate_subscripts(parts, 1) - 1 AS alt, unnest(parts) AS sel0 "
        f"FROM (SELECT scope, rule_ord, regexp_extract_all(selector, {q(ALTERNATIVE_RE)}, 0) AS parts FROM ({rules_src})))",
        f"{p}_a1 AS (SELECT scope, rule_ord, alt, {S.trim_ws('sel0')} AS sel FROM {p}_a0)",
        f"{p}_a2 AS (SELECT *, regexp_extract_all(sel, {q(COMP_RE)}, 0) AS comps FROM {p}_a1)",
        f"{p}_a3 AS (SELECT * FROM {p}_a2 WHERE sel <> '' AND array_to_string(comps, '') = sel)",
        f"{p}_c0 AS (SELECT scope, rule_ord, alt, len(comps) AS n_conds, generate_subscripts(comps, 1) AS ci, "
        f"unnest(comps) AS comp FROM {p}_a3)",
        f"{p}_conds AS (SELECT scope, rule_ord, alt, n_conds, ci, {key} AS key, {op} AS op, {value} AS value FROM {p}_c0)",
    ]


def facts_cte(name: str, els: str) -> str:
    cls = f"list_filter(string_split_regex(coalesce(a_class, ''), {q('[' + WS + ']+')}), lambda x: x <> '')"
    return (
        f"{name} AS (SELECT page_id, open_pos, host, 'tag' AS key, tag AS val FROM {els} "
        f"UNION ALL SELECT a.page_id, a.open_pos, x.host, '@' || a.name, a.value FROM el_attrs a "
        f"JOIN {els} x USING (page_id, open_pos) "
        f"UNION ALL SELECT page_id, open_pos, host, '.', unnest({cls}) FROM {els})"
    )


def holds(op: str, val: str, value: str) -> str:
    words = f"string_split_regex({val}, {q('[' + WS + ']+')})"
    return (f"(CASE WHEN {op} IN ('any', 'exists') THEN true WHEN {op} = 'eq' THEN {val} = {value} "
            f"WHEN {op} = 'contains' THEN {value} <> '' AND strpos({val}, {value}) > 0 "
            f"WHEN {op} = 'prefix' THEN {value} <> '' AND starts_with({val}, {value}) "
            f"WHEN {op} = 'suffix' THEN {value} <> '' AND ends_with({val}, {value}) "
            f"WHEN {op} = 'word' THEN list_contains({words}, {value}) "
            f"WHEN {op} = 'dash' THEN {val} = {value} OR starts_with({val}, {value} || '-') ELSE false END)")


def match_cte(name: str, facts: str, conds: str, by_host: bool) -> str:
    host = " AND f.host = c.scope" if by_host else ""
    return (
        f"{name}_h AS (SELECT f.page_id, f.open_pos, c.scope, c.rule_ord, c.alt, c.n_conds, c.ci FROM {facts} f "
        f"JOIN {conds} c ON f.key = c.key{host} WHERE {holds('c.op', 'f.val', 'c.value')}),\n"
        f"{name} AS (SELECT DISTINCT page_id, open_pos, scope, rule_ord FROM (SELECT page_id, open_pos, scope, rule_ord, alt "
        f"FROM {name}_h GROUP BY page_id, open_pos, scope, rule_ord, alt HAVING count(DISTINCT ci) = max(n_conds)))"
    )


def not_covered(toks: str, iv: str) -> str:
    return (f"SELECT t.* FROM {toks} t WHERE NOT EXISTS (SELECT 1 FROM {iv} i WHERE i.page_id = t.page_id "
            f"AND t.pos >= i.open_pos AND t.pos < i.stop_pos)")


def canonical_ctes(alternates_sql: str) -> list[str]:
    fm_f, fm_c = S.strip_front_matter(S.trim_ws("coalesce(a.text, '')"))
    return [
        f"canon_link AS (SELECT e.page_id, {S.resolve_url('e.a_href', 'p.url')} AS href FROM ee e JOIN pg p USING (page_id) "
        "WHERE e.tag = 'link' AND e.a_rel = 'alternate' AND e.a_type = 'text/markdown' AND coalesce(e.a_href, '') <> '' "
        "QUALIFY row_number() OVER (PARTITION BY e.page_id ORDER BY e.open_pos) = 1)",
        f"alts AS ({alternates_sql})",
        f"canon0 AS (SELECT l.page_id, {S.trim_ws(fm_c)} AS content FROM canon_link l JOIN alts a ON a.url = l.href "
        "WHERE a.status BETWEEN 200 AND 299)",
        "canon AS (SELECT page_id, content FROM canon0 WHERE content <> '' "
        "QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY content) = 1)",
    ]


def convert_ctes(extra_rules_sql: str | None = None, pages_sql: str | None = None, rules_sql: str | None = None,
                 alternates_sql: str | None = None) -> list[str]:
    ctes = base_ctes(pages_sql or "SELECT page_id, url, html FROM pages", rules_sql)
    if alternates_sql:
        ctes += canonical_ctes(alternates_sql)
    # root
    root_vals = ", ".join(f"('*', {r}, {q(s)})" for r, s in ROOT_FALLBACK)
    ctes += selector_ctes("rg", f"SELECT * FROM (VALUES {root_vals}) t(scope, rule_ord, selector)")
    ctes += selector_ctes("rs", "SELECT domain AS scope, 0 AS rule_ord, selector FROM rules")
    ctes.append(facts_cte("fa", "ee"))
    ctes.append(match_cte("m_rg", "fa", "rg_conds", False))
    ctes.append(match_cte("m_rs", "fa", "rs_conds", True))
    ctes.append("with_rule AS (SELECT DISTINCT p.page_id FROM pg p JOIN rules r ON p.host = r.domain)")
    ctes.append(
        "root_n AS (SELECT m.page_id, m.open_pos, m.rule_ord, e.end_pos FROM "
        "(SELECT * FROM m_rg WHERE rule_ord > 1 OR page_id NOT IN (SELECT page_id FROM with_rule) "
        "UNION ALL SELECT * FROM m_rs) m JOIN elements e USING (page_id, open_pos))")
    blocks, boxes = "('p', 'pre', 'td', 'blockquote', 'li', 'dd')", "('article', 'main', 'section', 'div', 'td', 'body')"
    inner = "max(e.open_pos)"  # the innermost of those that hold a place begins last
    holds = "e.page_id = t.page_id AND e.open_pos < t.pos AND t.pos < e.end_pos"
    ctes += [
        "sp AS (SELECT page_id FROM pg WHERE page_id NOT IN (SELECT page_id FROM root_n WHERE rule_ord < 3))",
        "se AS (SELECT e.page_id, e.tag, e.open_pos, e.end_pos FROM elements e JOIN sp USING (page_id))",
        "sx AS (SELECT t.page_id, t.pos, t.text, EXISTS (SELECT 1 FROM se e WHERE e.tag = 'a' AND " + holds + ") AS linked "
        "FROM tx t JOIN sp USING (page_id) WHERE t.kind = 'text')",
        f"sb AS (SELECT t.page_id, t.pos, t.text, {inner} AS b FROM sx t JOIN se e ON {holds} AND e.tag IN {blocks} GROUP BY ALL)",
        f"ss AS (SELECT page_id, b AS pos, {S.trim_ws(S.collapse_inline_ws('x'))} AS x FROM (SELECT page_id, b, string_agg(text, '' ORDER BY pos) AS x FROM sb GROUP BY ALL))",
        "sv0 AS (SELECT page_id, pos, (1 + length(x) - length(replace(x, ',', '')) + least(length(x) // 100, 3))::DOUBLE AS s FROM ss WHERE length(x) >= 25)",
        f"sf AS (SELECT page_id, c AS pos, sum(s) AS s FROM (SELECT t.page_id, t.pos, t.s, {inner} AS c FROM sv0 t JOIN se e ON {holds} AND e.tag IN {boxes} GROUP BY ALL) GROUP BY ALL)",
        f"sh AS (SELECT page_id, c AS pos, s / 2 AS s FROM (SELECT t.page_id, t.pos, t.s, {inner} AS c FROM sf t JOIN se e ON {holds} AND e.tag IN {boxes} GROUP BY ALL))",
        "st AS (SELECT page_id, pos AS open_pos, sum(s) AS s FROM (SELECT * FROM sf UNION ALL SELECT * FROM sh) GROUP BY ALL)",
        f"sd AS (SELECT e.page_id, e.open_pos, e.end_pos, sum(length({S.trim_ws('t.text')})) AS n, coalesce(sum(length({S.trim_ws('t.text')})) FILTER (WHERE linked), 0) AS l "
        f"FROM se e JOIN sx t ON {holds} WHERE e.tag IN {boxes} GROUP BY ALL)",
        "root_c AS (SELECT page_id, open_pos, rule_ord, end_pos FROM root_n UNION ALL SELECT page_id, open_pos, 3, end_pos FROM (SELECT page_id, open_pos, end_pos, "
        "s * (1 - l::DOUBLE / greatest(n, 1)) AS score FROM st JOIN sd USING (page_id, open_pos)) "
        "QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, open_pos) = 1)"]
    ctes.append(
        "root AS (SELECT p.page_id, coalesce(b.open_pos, -1) AS root_open, coalesce(b.end_pos, 1073741824) AS root_end "
        "FROM pg p LEFT JOIN (SELECT * FROM root_c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rule_ord, open_pos) = 1) b "
        "USING (page_id))")
    skip = " AND t.page_id NOT IN (SELECT page_id FROM canon)" if alternates_sql else ""
    ctes.append("ct AS (SELECT t.* FROM tx t JOIN root r USING (page_id) WHERE t.pos > r.root_open AND t.pos < r.root_end"
                + skip + ")")
    ctes.append("ce AS (SELECT e.* FROM ee e JOIN root r USING (page_id) WHERE e.open_pos > r.root_open AND e.open_pos < r.root_end)")
    # P1 / P2
    dvals = ", ".join(f"('*', {i}, {q(s)})" for i, s in enumerate([*DEFAULT_REMOVE_SELECTORS, ", ".join(DROPPED_WITH_CONTENT)]))
    extra = f" UNION ALL {extra_rules_sql}" if extra_rules_sql else ""
    ctes += selector_ctes("dr", f"SELECT * FROM (VALUES {dvals}) t(scope, rule_ord, selector){extra}")
    ctes += selector_ctes("sr", "SELECT domain AS scope, (generate_subscripts(remove, 1) - 1)::INTEGER AS rule_ord, "
                                "unnest(remove) AS selector FROM rules")
    ctes.append(f"cm AS (SELECT * FROM ce WHERE tag NOT IN {inlist(REPLACED_TAGS)})")
    ctes.append(facts_cte("fc", "cm"))
    ctes.append(match_cte("m_dr", "fc", "dr_conds", False))
    ctes.append(match_cte("m_sr", "fc", "sr_conds", True))
    ctes.append("iv1 AS (SELECT DISTINCT e.page_id, e.open_pos, e.stop_pos FROM ce e JOIN m_dr m USING (page_id, open_pos))")
    ctes.append(f"t1 AS ({not_covered('ct', 'iv1')})")
    ctes.append("iv2 AS (SELECT DISTINCT e.page_id, e.open_pos, e.stop_pos FROM ce e JOIN m_sr m USING (page_id, open_pos))")
    ctes.append(f"t2 AS ({not_covered('t1', 'iv2')})")
    # P4 / P5
    hidden = (f"(a_hidden IS NOT NULL OR a_aria_hidden = 'true' "
              f"OR regexp_matches(lower(coalesce(a_style, '')), '(^|;)\\s*display\\s*:\\s*none\\s*(!important\\s*)?(;|$)') "
              f"OR regexp_matches(lower(coalesce(a_style, '')), '(^|;)\\s*visibility\\s*:\\s*hidden\\s*(!important\\s*)?(;|$)'))")
    ctes.append("sv AS (SELECT e.* FROM ce e WHERE EXISTS (SELECT 1 FROM t2 WHERE t2.page_id = e.page_id "
                "AND t2.pos = e.open_pos AND t2.kind IN ('open','void','raw')))")
    ctes.append(f"live AS (SELECT e.* FROM ce e WHERE e.tag NOT IN {inlist(MEDIA_TAGS)} AND e.tag NOT IN {inlist(REPLACED_TAGS)} AND EXISTS (SELECT 1 FROM t2 "
                f"WHERE t2.page_id = e.page_id AND t2.pos = e.open_pos AND t2.kind IN ('open','void','raw')))")
    size = ["coalesce(TRY_CAST(" + S.rx(f"coalesce({a}, '0')", f"^[{WS}]*([+-]?[0-9]+)", 1) + " AS INTEGER), 0)" for a in ("a_width", "a_height")]
    ctes.append(f"ivi AS (SELECT page_id, open_pos, stop_pos FROM ce WHERE tag = 'svg' AND {size[0]} BETWEEN 1 AND 47 AND {size[1]} BETWEEN 1 AND 47)")
    ctes.append(f"tp AS ({not_covered('t2', 'ivi')})")
    ctes.append(
        f"inside AS (SELECT e.page_id, e.open_pos, "
        f"count(t.pos) FILTER (WHERE t.kind = 'text' AND {S.trim_ws('t.text')} <> '') AS w_text, "
        f"count(t.pos) FILTER (WHERE t.kind IN ('open','void') AND t.tag IN {inlist(MEDIA_CONTENT_TAGS)}) AS w_media, "
        f"count(t.pos) FILTER (WHERE t.kind IN ('open','void') AND t.tag IN {inlist(REPLACED_TAGS)}) AS w_repl "
        f"FROM live e LEFT JOIN tp t ON t.page_id = e.page_id AND t.pos > e.open_pos AND t.pos < e.end_pos "
        f"GROUP BY e.page_id, e.open_pos)")
    ctes.append(
        f"iv3 AS (SELECT e.page_id, e.open_pos, e.stop_pos FROM live e JOIN inside USING (page_id, open_pos) "
        f"WHERE {hidden} OR (w_text + w_media + w_repl = 0 AND e.tag NOT IN {inlist(EMPTY_EXEMPT)} AND e.ekind <> 'raw'))")
    ctes.append(f"t3 AS ({not_covered('t2', 'iv3')})")
    tiny = ("(coalesce(TRY_CAST(" + S.rx("coalesce(a_width, '0')", f"^[{WS}]*([+-]?[0-9]+)", 1) + " AS INTEGER), 0) BETWEEN 1 AND 31 "
            "AND coalesce(TRY_CAST(" + S.rx("coalesce(a_height, '0')", f"^[{WS}]*([+-]?[0-9]+)", 1) + " AS INTEGER), 0) BETWEEN 1 AND 31)")
    ctes.append(f"iv4 AS (SELECT page_id, open_pos, stop_pos FROM ce WHERE tag = 'img' AND {tiny})")
    ctes.append(f"kt AS ({not_covered('t3', 'iv4')})")
    ctes.append("ke AS (SELECT e.* FROM ce e WHERE EXISTS (SELECT 1 FROM kt WHERE kt.page_id = e.page_id "
                "AND kt.pos = e.open_pos AND kt.kind IN ('open','void','raw')))")
    # headings
    ctes.append(
        f"hd0 AS (SELECT h.page_id, h.open_pos, h.end_pos, h.tag, h.a_id AS given_id, "
        f"coalesce(string_agg(t.text, '' ORDER BY t.pos), '') AS text FROM ke h LEFT JOIN kt t "
        f"ON t.page_id = h.page_id AND t.kind = 'text' AND t.pos > h.open_pos AND t.pos < h.end_pos "
        f"WHERE h.tag IN {inlist(HEADINGS)} GROUP BY ALL)")
    ctes.append(
        f"hd1 AS (SELECT *, CASE WHEN coalesce(given_id, '') <> '' THEN given_id ELSE {S.slugify('text')} END AS base FROM hd0)")
    ctes.append("hd2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, base ORDER BY open_pos) - 1 AS n FROM hd1)")
    ctes.append(
        "headings AS (SELECT page_id, open_pos AS pos, substr(tag, 2, 1)::INTEGER AS level, text, "
        "CASE WHEN coalesce(given_id, '') <> '' THEN given_id ELSE (CASE WHEN n = 0 THEN base ELSE base || '-' || n::VARCHAR END) END AS id, "
        "CASE WHEN n = 0 THEN base ELSE base || '-' || n::VARCHAR END AS slug FROM hd2)")
    line = f"repeat('  ', level - 1) || '- [' || {S.trim_ws('text')} || '](#' || slug || ')'"
    ctes.append(
        f"toc AS (SELECT p.page_id, coalesce(string_agg({line}, chr(10) ORDER BY h.pos), '') AS toc "
        f"FROM pg p LEFT JOIN headings h USING (page_id) GROUP BY p.page_id)")
    # links
    ctes.append(
        f"links AS (SELECT a.page_id, a.open_pos AS pos, a.a_href AS href_raw, {S.clean_href('a.a_href', 'p.url')} AS href_clean, "
        f"coalesce((SELECT string_agg(t.text, '' ORDER BY t.pos) FROM kt t WHERE t.page_id = a.page_id AND t.kind = 'text' "
        f"AND t.pos > a.open_pos AND t.pos < a.end_pos), '') AS text "
        f"FROM ke a JOIN pg p USING (page_id) WHERE a.tag = 'a' AND a.a_href IS NOT NULL)")
    # page meta
    ctes.append(
        "ttl AS (SELECT * FROM ee WHERE tag = 'title' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY open_pos) = 1)")
    ctes.append(
        "ttl_t AS (SELECT e.page_id, string_agg(t.text, '' ORDER BY t.pos) AS title FROM ttl e JOIN tx t "
        "ON t.page_id = e.page_id AND t.kind = 'text' AND t.pos > e.open_pos AND t.pos < e.end_pos GROUP BY e.page_id)")
    ctes.append(
        "mt AS (SELECT * FROM ee WHERE tag = 'meta' AND a_name IN ('description', 'author') "
        "QUALIFY row_number() OVER (PARTITION BY page_id, a_name ORDER BY open_pos) = 1)")
    ttl = S.trim_ws(S.rr("coalesce(tt.title, '')", r"[ \t\n\f\r]+", " "))
    ctes.append(
        f"page_meta AS (SELECT p.page_id, {ttl} AS title, p.url AS source, "
        f"coalesce((SELECT coalesce(a_content, '') FROM mt WHERE mt.page_id = p.page_id AND a_name = 'author'), '') AS author, "
        f"coalesce((SELECT coalesce(a_content, '') FROM mt WHERE mt.page_id = p.page_id AND a_name = 'description'), '') AS description "
        f"FROM pg p LEFT JOIN ttl_t tt USING (page_id))")
    # what elements write
    ctes.append(
        "kin AS (SELECT e.page_id, e.open_pos, (SELECT count(*) FROM kt t WHERE t.page_id = e.page_id AND t.kind IN ('open','void') "
        "AND t.pos > e.open_pos AND t.pos < e.end_pos) AS w_el FROM ke e WHERE e.tag IN ('a', 'h1','h2','h3','h4','h5','h6'))")
    ctes.append(
        f"unwrap AS (SELECT a.page_id, a.open_pos, true AS unwrap FROM ke a JOIN kin ka USING (page_id, open_pos) "
        f"JOIN ke h ON h.page_id = a.page_id AND h.tag IN {inlist(HEADINGS)} AND a.open_pos > h.open_pos AND a.open_pos < h.end_pos "
        f"JOIN kin kh ON kh.page_id = h.page_id AND kh.open_pos = h.open_pos WHERE a.tag = 'a' AND kh.w_el = ka.w_el + 1)")
    ctes.append(
        "lt0 AS (SELECT page_id, pos, kind, tag, sum(CASE WHEN tag IN ('ul','ol') AND kind = 'open' THEN 1 "
        "WHEN tag IN ('ul','ol') AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos "
        "ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM kt WHERE tag IN ('ul','ol','li') AND kind IN ('open','close'))")
    ctes.append(
        "lt1 AS (SELECT *, last_value(CASE WHEN tag IN ('ul','ol') THEN {'p': pos, 't': tag} END IGNORE NULLS) "
        "OVER (PARTITION BY page_id, depth ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lst FROM lt0 WHERE kind = 'open')")
    ctes.append(
        "lis AS (SELECT t.page_id, t.pos AS open_pos, t.lst.t AS list_tag, row_number() OVER (PARTITION BY t.page_id, t.lst.p ORDER BY t.pos) "
        "- 1 + coalesce(TRY_CAST(regexp_extract(l.a_start, '^\\s*(\\d+)', 1) AS INTEGER), 1) AS ordinal FROM lt1 t "
        "LEFT JOIN ke l ON l.page_id = t.page_id AND l.open_pos = t.lst.p WHERE t.tag = 'li')")
    ctes.append(
        "spans0 AS (SELECT e.page_id, e.open_pos, string_agg(t.text, '' ORDER BY t.pos) AS ct FROM ke e JOIN kt t ON t.page_id = e.page_id "
        "AND t.kind = 'text' AND t.pos > e.open_pos AND t.pos < e.end_pos WHERE e.tag = 'code' GROUP BY ALL)")
    runs = "list_transform(regexp_extract_all(ct, '`+'), lambda x: length(x))"
    ctes.append(
        f"ticks AS (SELECT page_id, open_pos, repeat('`', (list_filter(range(1, len({runs}) + 2), lambda n: NOT list_contains({runs}, n)))[1]) "
        f"|| CASE WHEN starts_with(ct, '`') OR ends_with(ct, '`') THEN ' ' ELSE '' END AS ticks FROM spans0 WHERE contains(ct, '`'))")
    ctes.append(
        "boxes AS (SELECT e.page_id, e.open_pos, CASE WHEN e.a_checked IS NOT NULL THEN 'x' ELSE ' ' END AS box FROM ke e "
        "JOIN ke l ON l.page_id = e.page_id AND l.open_pos = (SELECT max(f.open_pos) FROM ke f WHERE f.page_id = e.page_id "
        "AND f.open_pos < e.open_pos AND e.open_pos < f.stop_pos) WHERE e.tag = 'input' AND lower(e.a_type) = 'checkbox' AND l.tag = 'li')")
    link_ok = f"({S.safe_href('l.href_clean')} IS NOT NULL AND u.unwrap IS NULL)"
    title = "coalesce(e.a_title, '')"
    marker = "CASE WHEN e.tag = 'li' THEN CASE WHEN li.list_tag = 'ol' THEN li.ordinal::VARCHAR || '.  ' ELSE '-   ' END END"
    open_md = (
        f"CASE WHEN e.tag IN {inlist(HEADINGS)} THEN repeat('#', substr(e.tag, 2, 1)::INTEGER) || ' ' "
        f"WHEN e.tag IN ('b','strong') THEN '**' WHEN e.tag IN ('i','em') THEN '_' "
        f"WHEN e.tag IN ('del','s','strike') THEN '~~' WHEN e.tag = 'code' THEN coalesce(tk.ticks, '`') "
        f"WHEN e.tag = 'a' THEN CASE WHEN {link_ok} THEN '[' END "
        f"WHEN e.tag = 'input' THEN '[' || tb.box || '] ' WHEN e.tag = 'br' THEN '  ' || chr(10) WHEN e.tag = 'hr' THEN '* * *' END")
    close_md = (
        f"CASE WHEN e.tag IN {inlist(HEADINGS)} THEN CASE WHEN coalesce(hh.id, '') <> '' THEN ' {{#' || hh.id || '}}' END "
        f"WHEN e.tag IN ('b','strong') THEN '**' WHEN e.tag IN ('i','em') THEN '_' "
        f"WHEN e.tag IN ('del','s','strike') THEN '~~' WHEN e.tag = 'code' THEN reverse(coalesce(tk.ticks, '`')) "
        f"WHEN e.tag = 'a' THEN CASE WHEN {link_ok} THEN '](' || l.href_clean || "
        f"CASE WHEN {title} <> '' THEN ' \"' || {title} || '\"' ELSE '' END || ')' END END")
    ctes.append(
        f"el_md AS (SELECT e.page_id, e.open_pos, e.end_pos, e.ekind, e.tag, {open_md} AS omd, {close_md} AS cmd, {marker} AS marker FROM ke e "
        f"LEFT JOIN headings hh ON hh.page_id = e.page_id AND hh.pos = e.open_pos "
        f"LEFT JOIN links l ON l.page_id = e.page_id AND l.pos = e.open_pos "
        f"LEFT JOIN unwrap u ON u.page_id = e.page_id AND u.open_pos = e.open_pos "
        f"LEFT JOIN lis li ON li.page_id = e.page_id AND li.open_pos = e.open_pos "
        f"LEFT JOIN ticks tk ON tk.page_id = e.page_id AND tk.open_pos = e.open_pos "
        f"LEFT JOIN boxes tb ON tb.page_id = e.page_id AND tb.open_pos = e.open_pos)")
    from . import extract_sql as EX
    ctes += EX.images_ctes()
    ctes.append("inl_img AS (SELECT e.page_id, e.open_pos, e.stop_pos, i.markdown AS md FROM x_images i JOIN ce e "
                "ON e.page_id = i.page_id AND e.open_pos = i.pos)")
    ctes += footnote_ctes()
    # replacements (media, svg, code, tables, images)
    ctes += EX.all_ctes()
    esc = S.escape_markdown_text("description")
    ctes.append(
        "repl0 AS (SELECT page_id, open_pos, md, NULL AS how FROM fn_repl UNION ALL SELECT page_id, pos AS open_pos, chr(10) || chr(10) || '> ' || " + esc + " || chr(10) || chr(10) AS md, NULL FROM x_media "
        "UNION ALL SELECT page_id, pos, CASE WHEN action = 'removed' THEN '' ELSE chr(10) || chr(10) || description || chr(10) || chr(10) END, NULL FROM x_svgs "
        "UNION ALL SELECT page_id, pos, chr(10) || chr(10) || markdown || chr(10) || chr(10), 'code' FROM x_code WHERE fenced "
        "UNION ALL SELECT page_id, open_pos, '', NULL FROM x_widgets "
        "UNION ALL SELECT page_id, table_pos, chr(10) || chr(10) || markdown || chr(10) || chr(10), NULL FROM x_tables "
        "UNION ALL SELECT page_id, pos, markdown, NULL FROM x_images "
        "UNION ALL SELECT page_id, pos, markdown, NULL FROM x_figures)")
    ctes.append(
        "repl AS (SELECT r.page_id, r.open_pos, e.stop_pos, r.md, r.how FROM repl0 r JOIN ce e USING (page_id, open_pos) "
        "WHERE EXISTS (SELECT 1 FROM kt WHERE kt.page_id = r.page_id AND kt.pos = r.open_pos AND kt.kind IN ('open','void')))")
    ctes.append("rt AS (SELECT t.* FROM kt t WHERE NOT EXISTS (SELECT 1 FROM repl r WHERE r.page_id = t.page_id "
                "AND t.pos > r.open_pos AND t.pos < r.stop_pos))")
    ctes.append("kr AS (SELECT e.* FROM ke e WHERE EXISTS (SELECT 1 FROM rt WHERE rt.page_id = e.page_id AND rt.pos = e.open_pos "
                "AND rt.kind IN ('open','void','raw')) AND NOT EXISTS (SELECT 1 FROM repl r WHERE r.page_id = e.page_id "
                "AND r.open_pos = e.open_pos))")
    # render
    gap = f"CASE WHEN e.tag = 'li' THEN 1 WHEN e.tag IN {inlist(BLOCK_TAGS)} THEN 2 END"
    ctes.append(
        f"frag_el AS (SELECT e.page_id, e.open_pos, e.end_pos, e.ekind, e.tag, e.omd, e.cmd, {gap} AS gap, e.marker FROM el_md e "
        "JOIN kr USING (page_id, open_pos))")
    blockish = f"((kind IN ('open','close','void') AND tag IN {inlist(BLOCK_TAGS)}) OR kind = 'raw')"
    ctes.append(
        f"nb AS (SELECT *, coalesce(lag({blockish} OR coalesce(tag = 'input', false)) OVER w, true) AS prev_b, coalesce(lead({blockish}) OVER w, true) AS next_b, "
        f"sum(CASE WHEN tag = 'code' AND kind = 'open' THEN 1 WHEN tag = 'code' AND kind = 'close' THEN -1 ELSE 0 END) "
        f"OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS in_code, "
        f"sum(CASE WHEN tag = 'pre' AND kind = 'open' THEN 1 WHEN tag = 'pre' AND kind = 'close' THEN -1 ELSE 0 END) "
        f"OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS in_pre "
        f"FROM rt WINDOW w AS (PARTITION BY page_id ORDER BY pos))")
    ctes.append("lr AS (SELECT * FROM repl WHERE md <> '' AND EXISTS (SELECT 1 FROM rt WHERE rt.page_id = repl.page_id "
                "AND rt.pos = repl.open_pos AND rt.kind IN ('open','void')))")
    one = S.collapse_inline_ws("text")
    trimmed = f"regexp_replace(regexp_replace({one}, CASE WHEN prev_b THEN '^ +' ELSE '^$' END, ''), CASE WHEN next_b THEN ' +$' ELSE '^$' END, '')"
    kept = S.rr("text", r"\r\n?", "\n")
    kept = f"CASE WHEN prev_b THEN {S.rr(kept, r'^([ \t]*\n)+', '')} ELSE {kept} END"
    kept = f"CASE WHEN next_b THEN {S.rr(kept, r'(\n[ \t]*)+\z', '')} ELSE {kept} END"
    trimmed = f"(CASE WHEN in_pre > 0 THEN {kept} ELSE {trimmed} END)"
    ctes.append(
        f"parts AS (SELECT page_id, open_pos AS k1, 1 AS k2, 0 AS k3, 0 AS k4, NULL AS md, gap AS brk, tag, NULL AS marker, NULL AS how FROM frag_el "
        f"UNION ALL SELECT page_id, open_pos, 1, 0, 1, NULL, NULL, tag, marker, NULL FROM frag_el WHERE tag IN ('li', 'blockquote') "
        f"UNION ALL SELECT page_id, open_pos, 1, 0, 2, omd, NULL, tag, NULL, NULL FROM frag_el "
        f"UNION ALL SELECT page_id, open_pos, 1, 0, 3, NULL, 2, tag, NULL, NULL FROM frag_el WHERE tag = 'hr' "
        f"UNION ALL SELECT page_id, end_pos, 0, -open_pos, 0, cmd, NULL, tag, NULL, NULL FROM frag_el WHERE ekind = 'open' "
        f"UNION ALL SELECT page_id, end_pos, 0, -open_pos, 1, NULL, NULL, tag, NULL, NULL FROM frag_el WHERE ekind = 'open' AND tag IN ('li', 'blockquote') "
        f"UNION ALL SELECT page_id, end_pos, 0, -open_pos, 2, NULL, gap, tag, NULL, NULL FROM frag_el WHERE ekind = 'open' "
        f"UNION ALL SELECT page_id, pos, 1, 0, 0, CASE WHEN in_code > 0 THEN {trimmed} ELSE {S.escape_markdown_text(trimmed)} END, NULL, NULL, NULL, "
        f"CASE WHEN in_code > 0 THEN NULL ELSE 'text' END FROM nb WHERE kind = 'text' AND NOT ({S.trim_ws('text')} = '' AND (prev_b OR next_b)) "
        f"UNION ALL SELECT page_id, open_pos, 1, 0, 0, NULL, 2, NULL, NULL, NULL FROM lr WHERE md LIKE chr(10) || chr(10) || '%' "
        f"UNION ALL SELECT page_id, open_pos, 1, 0, 2, regexp_replace(md, '^\\n+|\\n+$', '', 'g'), NULL, NULL, NULL, how FROM lr "
        f"UNION ALL SELECT page_id, open_pos, 1, 0, 3, NULL, 2, NULL, NULL, NULL FROM lr WHERE md LIKE chr(10) || chr(10) || '%')")
    ctes.append(
        "part1 AS (SELECT row_number() OVER () AS rid, page_id, k1, k2, k3, k4, nullif(md, '') AS md, brk, tag, marker, how FROM parts "
        "WHERE nullif(md, '') IS NOT NULL OR brk IS NOT NULL OR (tag IN ('li', 'blockquote') AND k4 = 1))")
    # the prefix of a part: one piece for each quote or list item that it is in
    ctes.append(
        "pre AS (SELECT p.rid, string_agg(CASE c.tag WHEN 'blockquote' THEN '> ' ELSE '    ' END, '' ORDER BY c.open_pos) AS prefix "
        "FROM part1 p JOIN frag_el c ON c.page_id = p.page_id AND c.ekind = 'open' AND c.tag IN ('li', 'blockquote') "
        "AND CASE WHEN p.k2 = 1 THEN c.open_pos < p.k1 + CASE WHEN p.k4 >= 1 THEN 1 ELSE 0 END AND c.end_pos > p.k1 "
        "ELSE c.end_pos >= p.k1 AND (c.open_pos < -p.k3 OR (c.open_pos = -p.k3 AND p.k4 = 0)) END GROUP BY p.rid)")
    ctes.append(
        "part2 AS (SELECT p.*, coalesce(prefix, '') AS prefix, count(md) OVER (PARTITION BY page_id ORDER BY k1, k2, k3, k4 "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM part1 p LEFT JOIN pre USING (rid))")
    ctes.append(
        "gaps AS (SELECT page_id, n, coalesce(max(CASE WHEN tag IN ('ul', 'ol') AND brk IS NOT NULL AND prefix LIKE '%    ' THEN 1 ELSE brk END), 0) AS wide, "
        "arg_min(prefix, length(prefix)) AS low, arg_max(marker, (k1, k2, k3, k4)) FILTER (WHERE marker IS NOT NULL) AS mark "
        "FROM part2 GROUP BY page_id, n)")
    ctes.append(
        "frag1 AS (SELECT t.*, g.wide, g.low, CASE WHEN g.mark IS NOT NULL THEN substr(t.prefix, 1, length(t.prefix) - 4) || g.mark "
        "ELSE t.prefix END AS first FROM part2 t JOIN gaps g USING (page_id, n) WHERE t.md IS NOT NULL)")
    ctes.append(
        "frag2 AS (SELECT *, n = 0 OR wide > 0 OR ends_with(lag(md, 1, chr(10)) OVER w, chr(10)) AS starts, "
        "2 * sum(CASE WHEN how = 'code' THEN 1 ELSE 0 END) OVER w - CASE WHEN how = 'code' THEN 1 ELSE 0 END AS seg "
        "FROM frag1 WINDOW w AS (PARTITION BY page_id ORDER BY k1, k2, k3, k4))")
    esc_line = "CASE WHEN (starts OR i > 1) AND how = 'text' THEN " + S.escape_line_start("l") + " ELSE l END"
    ctes.append(
        f"frags AS (SELECT page_id, k1, k2, k3, k4, seg, CASE WHEN n = 0 THEN first WHEN wide = 0 THEN '' WHEN wide = 1 THEN chr(10) || first "
        f"ELSE chr(10) || rtrim(low, ' ') || chr(10) || first END || array_to_string(list_transform(string_split(md, chr(10)), "
        f"lambda l, i: CASE WHEN i = 1 THEN '' WHEN l = '' AND i < len(string_split(md, chr(10))) THEN rtrim(prefix, ' ') ELSE prefix END "
        f"|| {esc_line}), chr(10)) AS md FROM frag2)")
    ctes.append(
        f"segs AS (SELECT page_id, seg, CASE WHEN seg % 2 = 1 THEN string_agg(md, '' ORDER BY k1, k2, k3, k4) "
        f"ELSE {S.normalize_markdown('string_agg(md, ' + q('') + ' ORDER BY k1, k2, k3, k4)')} END AS md FROM frags GROUP BY page_id, seg)")
    ctes.append(
        f"body0 AS (SELECT p.page_id, {S.trim_ws('coalesce(b.raw, ' + q('') + ')')} AS body FROM pg p LEFT JOIN "
        f"(SELECT page_id, string_agg(md, '' ORDER BY seg) AS raw FROM segs GROUP BY page_id) b USING (page_id))")
    ctes.append("body AS (SELECT b.page_id, CASE WHEN coalesce(a.appendix, '') <> '' THEN b.body || chr(10) || chr(10) || a.appendix "
                "ELSE b.body END AS body FROM body0 b LEFT JOIN fn_app a USING (page_id))")
    return ctes


def inline_ctes(name: str, containers: str, replaced: str) -> list[str]:
    """``{name}_md(page_id, c_open, md)``: Markdown in one line of what ``containers`` hold, ``replaced`` as given."""
    flat = S.collapse_inline_ws("text")
    breaks = inlist([*BLOCK_TAGS, "br"])
    inner = (f"FROM {containers} c WHERE c.page_id = t.page_id AND c.open_pos < t.pos AND c.end_pos > t.pos)")
    line = "string_agg(md, '' ORDER BY k1, k2, k3)"
    return [
        f"{name}_t AS (SELECT t.*, (SELECT max(c.open_pos) {inner} AS c_open FROM kt t WHERE NOT EXISTS (SELECT 1 FROM {replaced} r "
        "WHERE r.page_id = t.page_id AND t.pos >= r.open_pos AND t.pos < r.stop_pos))",
        f"{name}_c AS (SELECT *, sum(CASE WHEN tag = 'code' AND kind = 'open' THEN 1 WHEN tag = 'code' AND kind = 'close' THEN -1 ELSE 0 END) "
        f"OVER (PARTITION BY page_id, c_open ORDER BY pos ROWS UNBOUNDED PRECEDING) AS in_code FROM {name}_t WHERE c_open IS NOT NULL)",
        f"{name}_e AS (SELECT e.*, t.c_open FROM el_md e JOIN {name}_c t ON t.page_id = e.page_id AND t.pos = e.open_pos "
        f"WHERE t.kind IN ('open', 'void') AND e.tag NOT IN {breaks})",
        f"{name}_r AS (SELECT t.*, (SELECT max(c.open_pos) {inner} AS c_open FROM (SELECT page_id, open_pos AS pos, md FROM {replaced}) t)",
        f"{name}_p AS (SELECT page_id, c_open, pos AS k1, 1 AS k2, 0 AS k3, CASE WHEN kind = 'text' THEN CASE WHEN in_code > 0 THEN {flat} "
        f"ELSE {S.escape_markdown_text(flat)} END ELSE ' ' END AS md FROM {name}_c WHERE kind = 'text' OR (kind IN ('open', 'close', 'void') AND tag IN {breaks}) "
        f"UNION ALL SELECT page_id, c_open, open_pos, 1, 1, omd FROM {name}_e "
        f"UNION ALL SELECT page_id, c_open, end_pos, 0, -open_pos, cmd FROM {name}_e WHERE ekind = 'open' "
        f"UNION ALL SELECT page_id, c_open, pos, 1, 0, md FROM {name}_r WHERE c_open IS NOT NULL)",
        f"{name}_md AS (SELECT page_id, c_open, {S.trim_ws(S.collapse_inline_ws(line))} AS md FROM {name}_p WHERE md IS NOT NULL GROUP BY page_id, c_open)",
    ]


def documents_sql(retrieved: str = "2025-01-01T00:00:00.000Z", **kw) -> str:
    ctes = convert_ctes(**kw)
    fm = S.build_front_matter("m.title", "m.source", "m.author", "m.description", q(retrieved))
    if kw.get("alternates_sql"):
        ctes.append(
            f"documents AS (SELECT p.page_id, p.url, p.host, {fm} AS front_matter, "
            f"CASE WHEN c.content IS NOT NULL THEN '' ELSE t.toc END AS toc, coalesce(c.content, b.body) AS body, "
            f"CASE WHEN c.content IS NOT NULL THEN 'canonical' ELSE 'converted' END AS origin FROM pg p "
            f"JOIN page_meta m USING (page_id) JOIN toc t USING (page_id) JOIN body b USING (page_id) "
            f"LEFT JOIN canon c USING (page_id))")
        return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
    ctes.append(
        f"documents AS (SELECT p.page_id, p.url, p.host, {fm} AS front_matter, t.toc, b.body FROM pg p "
        f"JOIN page_meta m USING (page_id) JOIN toc t USING (page_id) JOIN body b USING (page_id))")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def footnote_ctes() -> list[str]:
    ws = q("[" + WS + "]+")
    cls = lambda a, c: f"list_contains(string_split_regex(coalesce({a}.a_class, ''), {ws}), {q(c)})"
    noteref = (f"(e.a_role = 'doc-noteref' OR e.a_data_footnote_ref IS NOT NULL OR {cls('e', 'footnote-ref')} "
               f"OR {cls('e', 'fnref')})")
    note = S.escape_line_start("coalesce(m.md, '')")
    step_lab = ("CASE WHEN f.raw_label <> '' AND NOT list_contains(l.used, f.raw_label) THEN f.raw_label "
                "ELSE (list_filter(range(f.ord, 2 * f.ord + 1), lambda n: NOT list_contains(l.used, n::VARCHAR))[1])::VARCHAR END")
    return [
        f"fn_a AS (SELECT e.page_id, e.open_pos AS pos, e.end_pos, e.stop_pos, e.a_href AS href, {noteref} AS noteref, "
        f"{S.target_id('e.a_href', 'p.url')} AS target FROM ke e JOIN pg p USING (page_id) WHERE e.tag = 'a' AND e.a_href IS NOT NULL)",
        "fn_sup AS (SELECT page_id, open_pos, end_pos, stop_pos FROM ke WHERE tag = 'sup')",
        "fn_first AS (SELECT s.page_id, s.open_pos AS s_open, s.stop_pos AS s_stop, (SELECT min(a.pos) FROM fn_a a "
        "WHERE a.page_id = s.page_id AND a.pos > s.open_pos AND a.pos < s.end_pos) AS apos FROM fn_sup s)",
        "fn_r1 AS (SELECT f.page_id, 1 AS phase, f.s_open AS ref_pos, f.s_stop AS stop_pos, a.pos AS anchor_pos, a.target "
        "FROM fn_first f JOIN fn_a a ON a.page_id = f.page_id AND a.pos = f.apos WHERE a.target <> '')",
        "fn_r2 AS (SELECT a.page_id, 2 AS phase, a.pos AS ref_pos, a.stop_pos, a.pos AS anchor_pos, a.target FROM fn_a a "
        "WHERE a.noteref AND a.target <> '' AND NOT EXISTS (SELECT 1 FROM fn_r1 r WHERE r.page_id = a.page_id AND r.anchor_pos = a.pos))",
        "fn_refs0 AS (SELECT * FROM fn_r1 UNION ALL SELECT * FROM fn_r2)",
        "fn_refs1 AS (SELECT r.*, (SELECT string_agg(t.text, '' ORDER BY t.pos) FROM kt t WHERE t.page_id = r.page_id "
        "AND t.kind = 'text' AND t.pos > r.anchor_pos AND t.pos < a.end_pos) AS atext FROM fn_refs0 r "
        "JOIN fn_a a ON a.page_id = r.page_id AND a.pos = r.anchor_pos)",
        f"fn_refs AS (SELECT page_id, phase, ref_pos, stop_pos, anchor_pos, target, {S.footnote_label('coalesce(atext, ' + q('') + ')')} "
        f"AS raw_label FROM fn_refs1)",
        "fn_fr0 AS (SELECT * FROM fn_refs QUALIFY row_number() OVER (PARTITION BY page_id, target ORDER BY phase, ref_pos) = 1)",
        "fn_fr AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY phase, ref_pos) AS ord FROM fn_fr0)",
        "fn_lab(page_id, ord, target, label, used) AS (SELECT page_id, ord, target, CASE WHEN raw_label <> '' THEN raw_label ELSE '1' END, "
        "[CASE WHEN raw_label <> '' THEN raw_label ELSE '1' END] FROM fn_fr WHERE ord = 1 "
        f"UNION ALL SELECT f.page_id, f.ord, f.target, {step_lab}, list_append(l.used, {step_lab}) FROM fn_lab l "
        "JOIN fn_fr f ON f.page_id = l.page_id AND f.ord = l.ord + 1)",
        f"fn_back AS (SELECT page_id, open_pos, stop_pos FROM ke WHERE (tag = 'a' AND (a_role = 'doc-backlink' "
        f"OR starts_with(coalesce(a_href, ''), '#fnref') OR starts_with(coalesce(a_href, ''), '#ref'))) "
        f"OR list_contains(string_split_regex(coalesce(a_class, ''), {ws}), 'footnote-backref'))",
        "fn_def0 AS (SELECT e.page_id, e.a_id AS target, e.open_pos, e.end_pos, e.stop_pos FROM ke e WHERE e.a_id IS NOT NULL "
        "AND EXISTS (SELECT 1 FROM fn_lab l WHERE l.page_id = e.page_id AND l.target = e.a_id) "
        "QUALIFY row_number() OVER (PARTITION BY e.page_id, e.a_id ORDER BY e.open_pos) = 1)",
        "fn_gone AS (SELECT page_id, open_pos, stop_pos, '' AS md FROM fn_back UNION ALL SELECT page_id, open_pos, stop_pos, md FROM inl_img i "
        "WHERE NOT EXISTS (SELECT 1 FROM fn_back b WHERE b.page_id = i.page_id AND b.open_pos = i.open_pos))",
        *inline_ctes("fn_in", "fn_def0", "fn_gone"),
        f"fn_def AS (SELECT d.page_id, d.target, d.open_pos, d.stop_pos, {note} AS note FROM fn_def0 d LEFT JOIN fn_in_md m "
        "ON m.page_id = d.page_id AND m.c_open = d.open_pos)",
        "fn_par AS (SELECT e.page_id, e.open_pos, (SELECT max(f.open_pos) FROM ke f WHERE f.page_id = e.page_id "
        "AND f.open_pos < e.open_pos AND e.open_pos < f.stop_pos) AS parent_open FROM ke e)",
        "fn_cnt AS (SELECT p.page_id, p.parent_open, count(*) AS n, count(d.open_pos) AS d FROM fn_par p LEFT JOIN fn_def d "
        "ON d.page_id = p.page_id AND d.open_pos = p.open_pos WHERE p.parent_open IS NOT NULL GROUP BY ALL)",
        "fn_lists AS (SELECT l.page_id, l.open_pos, l.stop_pos FROM ke l JOIN fn_cnt c ON c.page_id = l.page_id "
        "AND c.parent_open = l.open_pos WHERE l.tag IN ('ol','ul') AND c.n = c.d)",
        "fn_app AS (SELECT l.page_id, string_agg('[^' || l.label || ']: ' || replace(d.note, chr(10), chr(10) || '    '), chr(10) "
        "ORDER BY l.ord) AS appendix FROM fn_lab l JOIN fn_def d ON d.page_id = l.page_id AND d.target = l.target "
        "WHERE d.note <> '' GROUP BY l.page_id)",
        "fn_repl AS (SELECT r.page_id, r.ref_pos AS open_pos, '[^' || l.label || ']' AS md FROM fn_refs r "
        "JOIN fn_lab l ON l.page_id = r.page_id AND l.target = r.target "
        "UNION ALL SELECT page_id, open_pos, '' FROM fn_def UNION ALL SELECT page_id, open_pos, '' FROM fn_lists)",
    ]


def output_expr() -> str:
    return S.build_output("front_matter", "toc", "body")
