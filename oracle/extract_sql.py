"""DuckDB oracle for the extraction relations (as CTE blocks over the
conversion CTEs ``pg ke kt ce t2 sv``), reused by the fragment queries and by
the rendering oracle."""

from __future__ import annotations

from pagemill.functions.text import WS
from pagemill.operators.extract import CLASS_LANGUAGE_RE

from . import convert_sql as CV
from . import sqlfn as S
from .fragments_sql import fragment_sql
from .sqlfn import q


def ft(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ")"


def text_in(el: str, toks: str) -> str:
    return (f"(SELECT string_agg(tq.text, '' ORDER BY tq.pos) FROM {toks} tq WHERE tq.page_id = {el}.page_id "
            f"AND tq.kind = 'text' AND tq.pos > {el}.open_pos AND tq.pos < {el}.end_pos)")


def images_ctes() -> list[str]:
    lazy = "coalesce(" + ", ".join(
        f"CASE WHEN coalesce({CV.col(a)}, '') <> '' AND NOT starts_with({CV.col(a)}, 'data:') THEN {CV.col(a)} END"
        for a in ["data-src", "data-original", "data-lazy-src", "data-src-large", "data-image-src"]) + ")"
    fs = "coalesce(" + ", ".join(
        f"CASE WHEN coalesce({CV.col(a)}, '') <> '' THEN {S.best_srcset(CV.col(a))} END"
        for a in ["data-srcset", "data-lazy-srcset", "data-original-srcset", "srcset"]) + ")"
    chosen = "coalesce(i.lazy, i.from_srcset, f.from_picture)"
    src = (f"CASE WHEN {chosen} IS NOT NULL THEN {S.resolve_url(chosen, 'p.url')} "
           f"WHEN coalesce(i.a_src, '') <> '' THEN {S.resolve_url('i.a_src', 'p.url')} ELSE '' END")
    md = (f"CASE WHEN src <> '' THEN '![' || {S.trim_ws('alt')} || '](' || src || "
          f"CASE WHEN {S.trim_ws('title')} <> '' THEN ' \"' || {S.trim_ws('title')} || '\"' ELSE '' END || ')' ELSE '' END")
    return [
        f"xi_img AS (SELECT e.*, {lazy} AS lazy, {fs} AS from_srcset FROM ke e WHERE tag = 'img')",
        "xi_pic AS (SELECT page_id, open_pos, end_pos FROM ke WHERE tag = 'picture')",
        f"xi_srcs AS (SELECT page_id, open_pos AS pos, {S.best_srcset(ft('a_data_srcset', 'a_srcset', 'a_data_src'))} AS best "
        "FROM ke WHERE tag = 'source' AND (a_srcset IS NOT NULL OR a_data_srcset IS NOT NULL OR a_data_src IS NOT NULL))",
        "xi_fsrc AS (SELECT p.page_id, p.open_pos AS pic_open, arg_min(s.best, s.pos) AS from_picture FROM xi_pic p JOIN xi_srcs s "
        "ON s.page_id = p.page_id AND s.pos > p.open_pos AND s.pos < p.end_pos WHERE s.best IS NOT NULL GROUP BY ALL)",
        "xi_imgp AS (SELECT i.*, (SELECT max(p.open_pos) FROM xi_pic p WHERE p.page_id = i.page_id AND i.open_pos > p.open_pos "
        "AND i.open_pos < p.end_pos) AS pic_open FROM xi_img i)",
        f"xi_res AS (SELECT i.page_id, i.open_pos AS pos, {src} AS src, coalesce(i.a_alt, '') AS alt, coalesce(i.a_title, '') AS title, "
        f"{S.int_prefix('i.a_width')} AS width, {S.int_prefix('i.a_height')} AS height FROM xi_imgp i JOIN pg p USING (page_id) "
        "LEFT JOIN xi_fsrc f ON f.page_id = i.page_id AND f.pic_open = i.pic_open)",
        f"x_images AS (SELECT page_id, pos, src, alt, title, width, height, {md} AS markdown FROM xi_res)",
    ]


def media_ctes() -> list[str]:
    own = ft("m.a_src", "m.a_data_src", "m.a_data_url")
    raw = f"coalesce({own}, CASE WHEN m.tag IN ('video','audio') THEN n.nested END, '')"
    return [
        "xm_m0 AS (SELECT * FROM sv WHERE tag IN ('iframe','video','audio'))",
        f"xm_srcs AS (SELECT page_id, open_pos AS pos, {ft('a_src', 'a_data_src', 'a_data_url')} AS s FROM sv "
        "WHERE tag = 'source' AND (a_src IS NOT NULL OR a_data_src IS NOT NULL OR a_data_url IS NOT NULL))",
        "xm_nest AS (SELECT m.page_id, m.open_pos, arg_min(coalesce(s.s, ''), s.pos) AS nested FROM xm_m0 m JOIN xm_srcs s "
        "ON s.page_id = m.page_id AND s.pos > m.open_pos AND s.pos < m.end_pos WHERE m.tag IN ('video','audio') GROUP BY ALL)",
        f"xm_m1 AS (SELECT m.page_id, m.open_pos, m.tag AS type, CASE WHEN {raw} <> '' THEN {S.resolve_url(raw, 'p.url')} ELSE '' END AS murl, "
        f"coalesce({ft('m.a_title', 'm.a_aria_label', 'm.a_data_title')}, '') AS title FROM xm_m0 m JOIN pg p USING (page_id) "
        "LEFT JOIN xm_nest n USING (page_id, open_pos))",
        f"xm_m2 AS (SELECT *, CASE WHEN murl <> '' THEN {S.url_provider('murl')} ELSE '' END AS provider FROM xm_m1)",
        "x_media AS (SELECT page_id, open_pos AS pos, type, murl AS url, provider, title, concat_ws(' — ', 'Embedded ' || type, "
        "CASE WHEN provider <> '' THEN 'from ' || provider END, CASE WHEN title <> '' THEN '\"' || title || '\"' END, "
        "CASE WHEN murl <> '' THEN murl END) AS description FROM xm_m2)",
    ]


def svgs_ctes() -> list[str]:
    w, h = S.int_prefix("s.a_width"), S.int_prefix("s.a_height")

    def child(tag):
        return (f"(SELECT {S.trim_ws('coalesce(' + text_in('c', 't2') + ', ' + q('') + ')')} FROM sv c WHERE c.page_id = s.page_id "
                f"AND c.tag = {q(tag)} AND c.open_pos > s.open_pos AND c.open_pos < s.end_pos ORDER BY c.open_pos LIMIT 1)")
    par = ("(SELECT max(f.open_pos) FROM sv f WHERE f.page_id = s.page_id AND f.open_pos < s.open_pos "
           "AND s.open_pos < f.stop_pos)")
    desc = ft("title", "dsc", "aria")
    return [
        f"xs_1 AS (SELECT s.page_id, s.open_pos, ({w} > 0 AND {w} < 48 AND {h} > 0 AND {h} < 48) AS icon, "
        f"{S.trim_ws('s.a_aria_label')} AS aria, {child('title')} AS title, {child('desc')} AS dsc, {par} AS parent_open, "
        f"coalesce(length({S.trim_ws(text_in('s', 't2'))}), 0) AS svg_len FROM sv s WHERE s.tag = 'svg')",
        f"xs_2 AS (SELECT xs_1.*, coalesce((SELECT length({S.trim_ws(text_in('pp', 't2'))}) FROM sv pp WHERE pp.page_id = xs_1.page_id "
        f"AND pp.open_pos = xs_1.parent_open), 0) AS parent_len FROM xs_1)",
        f"xs_3 AS (SELECT *, CASE WHEN icon THEN 'removed' WHEN {desc} IS NOT NULL THEN 'described' "
        f"WHEN parent_open IS NOT NULL AND parent_len > svg_len THEN 'removed' ELSE 'diagram' END AS action FROM xs_2)",
        f"x_svgs AS (SELECT page_id, open_pos AS pos, action, CASE WHEN action = 'described' THEN '[SVG: ' || {desc} || ']' "
        f"WHEN action = 'diagram' THEN '[SVG diagram]' END AS description FROM xs_3)",
    ]


def code_ctes() -> list[str]:
    def cls(c):
        return (f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), {q('[' + WS + ']+')}), "
                f"lambda t: regexp_extract(t, {q(CLASS_LANGUAGE_RE)}, 1)), lambda x: x <> '')")
    clsl = f"list_concat({cls('p.a_class')}, {cls('c.a_class')})"
    first_cls = f"list_filter(list_transform({clsl}, lambda x: {S.trim_ws('x')}), lambda x: x <> '')[1]"
    first_in = ("(SELECT {what} FROM {src} y WHERE y.page_id = {f}.page_id AND y.open_pos > {f}.open_pos AND y.open_pos < {f}.end_pos "
                "AND {cond} ORDER BY y.open_pos LIMIT 1)").format
    fig_text = lambda src, toks, cond: first_in(what=text_in("y", toks), src=src, f="f", cond=cond)
    panel = "list_contains(string_split_regex(coalesce(y.a_class, ''), " + q("[" + WS + "]+") + "), 'CodeBlockPanelTitle')"
    has = lambda c, v: f"list_contains(string_split_regex(coalesce({c}.a_class, ''), {q('[' + WS + ']+')}), {q(v)})"
    given_lang = "coalesce(nullif(p.a_data_language, ''), CASE WHEN xc_pc.is_first THEN xf.panel_lang END)"
    given_title = (f"coalesce(nullif(p.a_data_title, ''), CASE WHEN xc_pc.is_first THEN "
                   f"{ft(S.trim_ws('xf.own_panel'), S.trim_ws('xf.label'))} END)")
    lang = S.first_non_empty(given_lang, "p.a_data_language", "p.a_data_lang", "p.a_lang", "c.a_data_language", "c.a_data_lang", "c.a_lang",
                             "xf.a_data_language", first_cls)
    title0 = S.first_non_empty(given_title, "p.a_data_title", "p.a_title", "c.a_data_title", "c.a_title", "xf.fig_title",
                               "xf.panel_title", "xf.label", "xd.tab", "xd.selected")
    return [
        "xc_pre AS (SELECT * FROM ke WHERE tag = 'pre')",
        "xw_box AS (SELECT b.* FROM ke b WHERE (b.a_data_rehype_pretty_code_figure IS NOT NULL OR b.a_role = 'figure') AND EXISTS "
        "(SELECT 1 FROM xc_pre p WHERE p.page_id = b.page_id AND p.open_pos > b.open_pos AND p.open_pos < b.end_pos))",
        "x_widgets AS (SELECT DISTINCT w.page_id, w.open_pos, w.stop_pos FROM ke w JOIN xw_box b ON b.page_id = w.page_id "
        "AND w.open_pos > b.open_pos AND w.open_pos < b.end_pos WHERE w.tag = 'button' OR (b.a_data_rehype_pretty_code_figure IS NOT NULL "
        f"AND ({has('w', 'CodeBlockPanel')} OR {has('w', 'ScrollAreaScrollbar')})) OR (b.a_role = 'figure' AND w.a_role IN ('tablist', 'combobox')))",
        f"kw AS ({CV.not_covered('kt', 'x_widgets')})",
        "lw AS (SELECT e.* FROM ke e WHERE NOT EXISTS (SELECT 1 FROM x_widgets w WHERE w.page_id = e.page_id "
        "AND e.open_pos >= w.open_pos AND e.open_pos < w.stop_pos))",
        f"x_label AS (SELECT f.page_id, f.open_pos AS pos, nullif(f.a_aria_labelledby, '') AS label_id, (SELECT {text_in('y', 'tx')} FROM ee y "
        "WHERE y.page_id = f.page_id AND y.a_id = f.a_aria_labelledby ORDER BY y.open_pos LIMIT 1) AS label FROM ke f "
        "WHERE f.a_data_rehype_pretty_code_figure IS NOT NULL AND coalesce(f.a_aria_labelledby, '') <> '')",
        f"xc_fg AS (SELECT f.page_id, f.open_pos AS f_open, f.a_data_language, "
        f"{first_in(what='coalesce(nullif(y.a_data_language, {0}), nullif(y.a_data_lang, {0}))'.format(q('')), src='ke', f='f', cond='y.a_data_language IS NOT NULL')} AS panel_lang, "
        f"{fig_text('ke', 'kt', panel)} AS own_panel, {fig_text('lw', 'kw', 'y.a_data_rehype_pretty_code_title IS NOT NULL')} AS fig_title, "
        f"{fig_text('lw', 'kw', panel)} AS panel_title, (SELECT label FROM x_label l WHERE l.page_id = f.page_id AND l.pos = f.open_pos) AS label, "
        "(SELECT min(p.open_pos) FROM xc_pre p WHERE p.page_id = f.page_id AND p.open_pos > f.open_pos AND p.open_pos < f.end_pos) AS first_pre "
        "FROM ke f WHERE f.a_data_rehype_pretty_code_figure IS NOT NULL)",
        f"xc_dm AS (SELECT f.page_id, f.open_pos AS d_open, f.end_pos, {fig_text('lw', 'kw', 'y.a_role = ' + q('tab') + ' AND y.a_aria_selected = ' + q('true'))} AS tab, "
        f"{fig_text('lw', 'kw', 'y.a_data_selected IS NOT NULL')} AS selected FROM ke f WHERE f.a_data_demo IS NOT NULL)",
        "xc_pc AS (SELECT p.page_id, p.open_pos, (SELECT min(c.open_pos) FROM ke c WHERE c.page_id = p.page_id AND c.tag = 'code' "
        "AND c.open_pos > p.open_pos AND c.open_pos < p.end_pos) AS code_open, "
        "(SELECT max(f.open_pos) FROM ke f WHERE f.page_id = p.page_id AND f.a_data_rehype_pretty_code_figure IS NOT NULL "
        "AND p.open_pos > f.open_pos AND p.open_pos < f.end_pos) AS f_open, (SELECT max(d.d_open) FROM xc_dm d WHERE d.page_id = p.page_id "
        "AND p.open_pos > d.d_open AND p.open_pos < d.end_pos) AS d_open, "
        "EXISTS (SELECT 1 FROM xc_fg f WHERE f.page_id = p.page_id AND f.first_pre = p.open_pos) AS is_first FROM xc_pre p)",
        f"xc_cb AS (SELECT p.page_id, p.open_pos, lower({lang}) AS language, {title0} AS title0, xc_pc.code_open IS NOT NULL AS fenced, "
        f"coalesce(nullif({text_in('c', 'kw')}, ''), {text_in('p', 'kw')}, '') AS code_raw FROM xc_pre p JOIN xc_pc USING (page_id, open_pos) "
        "LEFT JOIN ke c ON c.page_id = p.page_id AND c.open_pos = xc_pc.code_open "
        "LEFT JOIN xc_fg xf ON xf.page_id = p.page_id AND xf.f_open = xc_pc.f_open "
        "LEFT JOIN xc_dm xd ON xd.page_id = p.page_id AND xd.d_open = xc_pc.d_open)",
        f"xc_cb2 AS (SELECT page_id, open_pos, fenced, language, CASE WHEN title0 IS NOT NULL THEN {S.squash_ws('title0')} END AS title, "
        f"{S.trim_fence_padding('code_raw')} AS code FROM xc_cb)",
        f"xc_cb3 AS (SELECT *, concat_ws(' ', language, CASE WHEN title IS NOT NULL THEN 'title=\"' || {S.escape_info_string('title')} "
        f"|| '\"' END) AS info FROM xc_cb2)",
        "x_code AS (SELECT page_id, open_pos AS pos, fenced, language, title, code, '```' || CASE WHEN info <> '' THEN ' ' || info ELSE '' END "
        "|| chr(10) || code || chr(10) || '```' AS markdown FROM xc_cb3)",
    ]


def tables_ctes() -> list[str]:
    clean = "replace(coalesce(m.md, ''), '|', '\\|')"
    return [
        "xt_ke AS (SELECT page_id, open_pos, end_pos, tag, CASE WHEN tag = 'th' THEN 'td' ELSE tag END AS g FROM ke "
        "WHERE tag IN ('table', 'tr', 'td', 'th'))",
        "xt_o AS (SELECT * FROM xt_ke e WHERE NOT EXISTS (SELECT 1 FROM xt_ke o WHERE o.page_id = e.page_id AND o.g = e.g "
        "AND o.open_pos < e.open_pos AND o.end_pos > e.open_pos))",
        "xt_tb AS (SELECT page_id, open_pos, end_pos FROM xt_o WHERE tag = 'table')",
        "xt_trs AS (SELECT r.page_id, r.open_pos, r.end_pos, (SELECT max(t.open_pos) FROM xt_tb t WHERE t.page_id = r.page_id "
        "AND r.open_pos > t.open_pos AND r.open_pos < t.end_pos) AS t_open FROM xt_o r WHERE r.tag = 'tr')",
        "xt_trs2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, t_open ORDER BY open_pos) AS row FROM xt_trs WHERE t_open IS NOT NULL)",
        "xt_cl AS (SELECT c.page_id, c.open_pos, c.end_pos, c.tag, (SELECT max(r.open_pos) FROM xt_trs2 r WHERE r.page_id = c.page_id "
        "AND c.open_pos > r.open_pos AND c.open_pos < r.end_pos) AS r_open FROM xt_o c WHERE c.tag IN ('td','th'))",
        "xt_cl2 AS (SELECT c.*, row_number() OVER (PARTITION BY c.page_id, c.r_open ORDER BY c.open_pos) AS col "
        "FROM xt_cl c WHERE r_open IS NOT NULL)",
        "xt_repl AS (SELECT page_id, open_pos, stop_pos, md FROM inl_img UNION ALL SELECT r.page_id, r.ref_pos, r.stop_pos, '[^' || l.label || ']' "
        "FROM fn_refs r JOIN fn_lab l ON l.page_id = r.page_id AND l.target = r.target)",
        *CV.inline_ctes("xt_in", "xt_cl", "xt_repl"),
        f"x_cells AS (SELECT c.page_id, r.t_open AS table_pos, r.row, c.col, c.tag = 'th' AS is_header, {clean} AS text "
        "FROM xt_cl2 c JOIN xt_trs2 r ON r.page_id = c.page_id AND r.open_pos = c.r_open "
        "LEFT JOIN xt_in_md m ON m.page_id = c.page_id AND m.c_open = c.open_pos)",
        "xt_rows AS (SELECT page_id, table_pos, row, '|' || string_agg(' ' || text || ' |', '' ORDER BY col) AS line "
        "FROM x_cells GROUP BY ALL)",
        "xt_nc AS (SELECT page_id, table_pos, count(*) AS n FROM x_cells WHERE row = 1 GROUP BY ALL)",
        "xt_rows2 AS (SELECT r.page_id, r.table_pos, r.row, CASE WHEN r.row = 1 THEN r.line || chr(10) || '|' || "
        "repeat(' --- |', coalesce(xt_nc.n, 1)) ELSE r.line END AS line FROM xt_rows r LEFT JOIN xt_nc USING (page_id, table_pos))",
        "x_tables AS (SELECT page_id, table_pos, string_agg(line, chr(10) ORDER BY row) AS markdown FROM xt_rows2 GROUP BY ALL)",
    ]


def figures_ctes() -> list[str]:
    cap = S.trim_ws("coalesce(" + text_in("c", "kt") + ", '')")
    return [
        "xf_fig AS (SELECT page_id, open_pos, end_pos FROM ke WHERE tag = 'figure')",
        "xf_own AS (SELECT i.page_id, i.pos, i.markdown, (SELECT max(f.open_pos) FROM xf_fig f WHERE f.page_id = i.page_id "
        "AND i.pos > f.open_pos AND i.pos < f.end_pos) AS f_open FROM x_images i)",
        "xf_cnt AS (SELECT page_id, f_open, count(*) AS n_img FROM xf_own WHERE f_open IS NOT NULL GROUP BY ALL)",
        "xf_md AS (SELECT page_id, f_open, string_agg(markdown, chr(10) || chr(10) ORDER BY pos) AS img_md FROM xf_own "
        "WHERE f_open IS NOT NULL AND markdown <> '' GROUP BY ALL)",
        f"xf_cap AS (SELECT f.page_id, f.open_pos AS f_open, (SELECT {cap} FROM ke c WHERE c.page_id = f.page_id "
        "AND c.tag = 'figcaption' AND c.open_pos > f.open_pos AND c.open_pos < f.end_pos ORDER BY c.open_pos LIMIT 1) AS caption "
        "FROM xf_fig f)",
        "x_figures AS (SELECT c.page_id, c.f_open AS pos, c.n_img::BIGINT AS images, coalesce(cp.caption, '') AS caption, "
        "chr(10) || chr(10) || coalesce(m.img_md, '') || CASE WHEN coalesce(cp.caption, '') <> '' THEN chr(10) || chr(10) "
        "|| '_' || cp.caption || '_' ELSE '' END || chr(10) || chr(10) AS markdown FROM xf_cnt c "
        "LEFT JOIN xf_md m USING (page_id, f_open) LEFT JOIN xf_cap cp USING (page_id, f_open))",
    ]


def all_ctes() -> list[str]:
    """Of all but the images, which notes need."""
    return media_ctes() + svgs_ctes() + code_ctes() + tables_ctes() + figures_ctes()


def figures_sql() -> str:
    return _standalone("frag_figures", "SELECT page_id, pos, images, caption, markdown FROM x_figures")


def _standalone(name: str, select: str) -> str:
    return CV.documents_sql(pages_sql=fragment_sql(name)) + select


def images_sql() -> str:
    return _standalone("frag_images", "SELECT page_id, pos, src, alt, title, width, height, markdown FROM x_images")


def media_sql() -> str:
    return _standalone("frag_media", "SELECT page_id, pos, type, url, provider, title, description FROM x_media")


def svgs_sql() -> str:
    return _standalone("frag_svg", "SELECT page_id, pos, action, description FROM x_svgs")


def code_sql() -> str:
    return _standalone("frag_code", "SELECT page_id, pos, language, title, code, markdown FROM x_code")


def sanitize_sql() -> str:
    from pagemill.operators import sanitize as Z
    scheme = f"lower({S.rx(S.rr('a.value', '[\\x00-\\x20]+', ''), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)})"
    tags = S.inlist([*Z.BLOCK_TAGS, *Z.INLINE_TAGS, *Z.MORE_TAGS])
    keep = (f"(a.name IN {S.inlist(Z.ATTRIBUTES)} OR starts_with(a.name, 'data-') OR starts_with(a.name, 'aria-')) AND "
            f"(a.name NOT IN {S.inlist(Z.LINK_ATTRIBUTES)} OR {scheme} = '' OR {scheme} IN {S.inlist(Z.SAFE_SCHEMES)} "
            f"OR ({scheme} = 'data' AND e.tag IN {S.inlist(Z.DATA_TAGS)}))")
    return _standalone("frag_sanitize", (
        f"SELECT e.page_id, e.open_pos, e.tag, k.name, k.value FROM elements e LEFT JOIN (SELECT a.* FROM el_attrs a JOIN elements e "
        f"USING (page_id, open_pos) WHERE {keep}) k USING (page_id, open_pos) WHERE e.tag IN {tags} AND NOT EXISTS "
        f"(SELECT 1 FROM elements x WHERE x.page_id = e.page_id AND x.tag IN {S.inlist(Z.DROPPED_WITH_CONTENT)} "
        "AND e.open_pos >= x.open_pos AND e.open_pos < x.stop_pos)"))


def labelled_by_sql() -> str:
    return _standalone("frag_code", "SELECT page_id, pos, label_id, label FROM x_label")


def code_widget_removal_sql() -> str:
    return _standalone("frag_code", "SELECT page_id, pos, kind, tag FROM kw")


def table_cells_sql() -> str:
    return _standalone("frag_tables", "SELECT page_id, table_pos, row, col, is_header, text FROM x_cells")


def render_table_sql() -> str:
    return _standalone("frag_tables", "SELECT page_id, table_pos, markdown FROM x_tables")
