"""DuckDB SQL expression builders used by the oracle queries.

Independent re-statement of each function in DuckDB SQL (RE2 regexes,
1-based lists, ``'g'`` flag, ``\\1`` back-references). Each helper takes SQL
expression text and returns SQL expression text.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pagemill.functions.text import WS, WS_NO_LF
from pagemill.functions.urls import TRACKING_KEYS, URL_RE
from pagemill.operators.tokens import (ATTR_PATTERN, BLOCK_TAGS, BOUND_TAGS, INLINE_TAGS, RAW_TEXT_OPEN, RAW_TEXT_TAGS, TOKEN_PATTERN,
                                       VOID_TAGS)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def inlist(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def rr(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def rx(x: str, pat: str, grp: int = 0) -> str:
    return f"regexp_extract({x}, {q(pat)}, {grp})"


def trim_ws(x: str) -> str:
    return rr(x, f"^[{WS}]+|[{WS}]+$", "")


def ltrim_ws(x: str) -> str:
    return rr(x, f"^[{WS}]+", "")


def squash_ws(x: str) -> str:
    return trim_ws(rr(x, f"[{WS}]+", " "))


def slugify(x: str) -> str:
    s = trim_ws(f"lower({x})")
    s = rr(s, f"[^A-Za-z0-9_{WS}-]", "")
    s = rr(s, f"[{WS}_-]+", "-")
    return rr(s, "^-+|-+$", "")


def nonblank(x: str) -> str:
    return f"nullif({trim_ws(x)}, '')"


def first_non_empty(*xs: str) -> str:
    return "coalesce(" + ", ".join(nonblank(x) for x in xs) + ")"


def escape_yaml(x: str) -> str:
    s = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = f"replace({s}, {q(a)}, {q(b)})"
    return s


def escape_info_string(x: str) -> str:
    return f"replace({x}, '\"', '\\\"')"


def normalize_markdown(x: str) -> str:
    s = rr(x, r"\n{3,}", "\n\n")
    s = rr(s, "[“”]", '"')
    s = rr(s, "[‘’]", "'")
    s = rr(s, " ", " ")
    return rr(s, f"[{WS_NO_LF}]+(\\n|\\z)", r"\1")


def post_process_markdown(x: str) -> str:
    return trim_ws(normalize_markdown(x))


def strip_front_matter(x: str) -> tuple[str, str]:
    """Returns (front_matter_expr, content_expr)."""
    tr = ltrim_ws(x)
    lines = f"string_split_regex({tr}, '\\r?\\n')"
    idx = f"coalesce(list_position(list_transform({lines}[2:], lambda l: {trim_ws('l')}), '---'), 0)"
    closed = f"({tr} LIKE '---%' AND {idx} > 0)"
    front = f"array_to_string({lines}[1:{idx} + 1], chr(10))"
    body = trim_ws(f"array_to_string({lines}[{idx} + 2:], chr(10))")
    return (f"CASE WHEN {closed} THEN {front} END",
            f"CASE WHEN {closed} THEN {body} ELSE {trim_ws(x)} END")


def trim_fence_padding(x: str) -> str:
    s = f"replace({x}, chr(13) || chr(10), chr(10))"
    s = rr(s, f"^([{WS_NO_LF}]*\\n)+", "")
    s = rr(s, f"(\\n[{WS_NO_LF}]*)+\\z", "")
    return f"CASE WHEN {trim_ws(s)} = '' THEN '' ELSE {s} END"


def footnote_label(x: str) -> str:
    return rr(trim_ws(x), r"^\[|\]$", "")


def int_prefix(x: str) -> str:
    n = rx(f"coalesce({x}, '0')", f"^[{WS}]*([+-]?[0-9]+)", 1)
    return f"coalesce(TRY_CAST({n} AS INTEGER), 0)"


def escape_markdown_text(x: str) -> str:
    return rr(x, r"([\\*_\[\]`])", r"\\\1")


def escape_line_start(x: str) -> str:
    """Of one line of text."""
    s = rr(x, r"^([ \t]*)(-[ \t-]|-$|=+[ \t]*$|>|~~~|\+[ \t]|\+$|#{1,6}[ \t]|#{1,6}$)", r"\1\\\2")
    return rr(s, r"^([ \t]*[0-9]{1,9})([.)])([ \t]|$)", r"\1\\\2\3")


def collapse_inline_ws(x: str) -> str:
    return rr(x, r"[ \t\n\r\f]+", " ")


def build_front_matter(title, source, author, description, retrieved) -> str:
    return ("('---' || chr(10) || 'title: \"' || " + escape_yaml(title)
            + " || '\"' || chr(10) || 'source: \"' || " + source
            + " || '\"' || chr(10) || 'retrieved: \"' || " + retrieved
            + " || '\"' || chr(10) || 'author: \"' || " + escape_yaml(author)
            + " || '\"' || chr(10) || 'description: \"' || " + escape_yaml(description)
            + " || '\"' || chr(10) || 'tags: []' || chr(10) || 'toc: true' || chr(10) || '---')")


def build_output(fm: str, toc: str, content: str) -> str:
    t = trim_ws(f"coalesce({toc}, '')")
    return (f"CASE WHEN {t} = '' THEN {fm} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {content} "
            f"ELSE {fm} || chr(10) || chr(10) || '## Table of Contents' || chr(10) || chr(10) || {t} "
            f"|| chr(10) || chr(10) || '---' || chr(10) || chr(10) || {content} END")


def decode_entities(x: str) -> str:
    names = {f"&{n};": chr(c) for n, c in name2codepoint.items()} | {"&apos;": "'"}
    table = f"MAP([{', '.join(map(q, names))}], [{', '.join(map(q, names.values()))}])"
    digits = rx("r", "^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = f"(CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN TRY_CAST('0x' || {digits} AS BIGINT) ELSE TRY_CAST({digits} AS BIGINT) END)"
    one = (f"CASE WHEN NOT starts_with(r, '&') THEN r WHEN starts_with(r, '&#') THEN CASE WHEN {code} > 0 AND {code} <= 1114111 "
           f"AND NOT {code} BETWEEN 55296 AND 57343 THEN chr({code}::INTEGER) ELSE r END ELSE coalesce({table}[r], r) END")
    pieces = f"regexp_extract_all({x}, {q('&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&')}, 0)"
    return f"CASE WHEN strpos({x}, '&') > 0 THEN array_to_string(list_transform({pieces}, lambda r: {one}), '') ELSE {x} END"


# ---------------------------------------------------------------- URLs
def _part(u: str, i: int) -> str:
    return rx(u, URL_RE, i)


def url_host(u: str) -> str:
    auth = _part(u, 3)
    return f"lower({rr(rr(auth, '^[^@]*@', ''), ':[0-9]*$', '')})"


def _encode_path(p: str) -> str:
    p2 = f"replace({p}, ' ', '%20')"
    enc = (f"array_to_string(list_transform(string_split({p2}, ''), lambda ch: "
           f"CASE WHEN regexp_matches(ch, '^[\\x00-\\x7F]*$') THEN ch ELSE url_encode(ch) END), '')")
    return f"CASE WHEN regexp_matches({p2}, '[^\\x00-\\x7F]') THEN {enc} ELSE {p2} END"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, so a long expression is written (and evaluated) once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _remove_dot_segments(path: str) -> str:
    return let("dp", path, _without_dots("dp"))


def _without_dots(p: str) -> str:
    segs = f"string_split({rr(p, '^/', '')}, '/')"
    up, here = "('..', '.%2e', '%2e.', '%2e%2e')", "('.', '%2e')"
    kept = (f"list_reduce({segs}, lambda acc, s: CASE WHEN lower(s) IN {up} THEN regexp_replace(acc, '/[^/]*$', '') "
            f"WHEN lower(s) IN {here} THEN acc ELSE acc || '/' || s END, '')")
    last = f"lower({segs}[-1])"
    return (f"(CASE WHEN regexp_matches({p}, '(?i)(\\.|%2e)(/|$)') THEN {kept} || CASE WHEN {last} IN {up} OR {last} IN {here} "
            f"THEN '/' ELSE '' END ELSE {p} END)")


def safe_href(u: str) -> str:
    h = rr(u, r"[\x00-\x20]+", "")
    scheme = f"lower({rx(h, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)})"
    return (f"(CASE WHEN {h} <> '' AND ({scheme} = '' OR {scheme} IN ('http', 'https', 'ftp', 'ftps', 'mailto', 'tel', 'callto', "
            f"'sms', 'cid', 'xmpp', 'matrix')) THEN {u} END)")


def _normalize_http(u: str) -> str:
    scheme = f"lower({_part(u, 1)})"
    auth = _part(u, 3)
    userinfo = rx(auth, "^([^@]*@)", 1)
    hostport = rr(auth, "^[^@]*@", "")
    host = f"lower({rr(hostport, ':[0-9]*$', '')})"
    port = rx(hostport, ":([0-9]*)$", 1)
    default = (f"(({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') "
               f"OR {port} = '')")
    path = _part(u, 4)
    path = f"(CASE WHEN {path} = '' THEN '/' ELSE {_remove_dot_segments(path)} END)"
    return (f"({scheme} || '://' || {userinfo} || {host} || CASE WHEN {default} THEN '' ELSE ':' || {port} END"
            f" || {_encode_path(path)} || {_encode_path(_part(u, 5))} || {_encode_path(_part(u, 6))})")


def resolve_url(href: str, base: str) -> str:
    trimmed = rr(rr(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    h = "hr"
    b_scheme, b_auth, b_path, b_query = _part(base, 1), _part(base, 3), _part(base, 4), _part(base, 5)
    b_path = f"(CASE WHEN {b_path} = '' THEN '/' ELSE {b_path} END)"
    prefix = f"({b_scheme} || '://' || {b_auth})"
    absolute = (f"(CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} "
                f"WHEN {h} LIKE '//%' THEN {b_scheme} || ':' || {h} "
                f"WHEN {h} LIKE '/%' THEN {prefix} || {h} "
                f"WHEN {h} LIKE '?%' THEN {prefix} || {b_path} || {h} "
                f"WHEN {h} LIKE '#%' THEN {prefix} || {b_path} || {b_query} || {h} "
                f"WHEN {h} = '' THEN {prefix} || {b_path} || {b_query} "
                f"ELSE {prefix} || {rr(b_path, '[^/]*$', '')} || {h} END)")
    is_http = f"(lower({_part('ab', 1)}) IN ('http', 'https') AND {_part('ab', 2)} <> '')"
    body = f"(CASE WHEN {is_http} THEN {_normalize_http('ab')} ELSE ab END)"
    return let("hr", trimmed, let("ab", absolute, body))


def strip_tracking(url: str) -> str:
    return let("su", url, _stripped("su"))


def _stripped(u: str) -> str:
    qs = rx(u, r"^[^?#]*\?([^#]*)", 1)
    has_q = f"regexp_matches({u}, '^[^?#]*\\?')"
    pairs = f"list_filter(string_split({qs}, '&'), lambda p: p <> '')"
    key = "lower(regexp_extract(p, '^([^=]*)', 1))"
    drop = f"({key} LIKE 'utm\\_%' ESCAPE '\\' OR {key} IN {inlist(TRACKING_KEYS)})"
    kept = f"list_filter({pairs}, lambda p: NOT {drop})"
    changed = f"len(list_filter({pairs}, lambda p: {drop})) > 0"
    rebuilt = (f"array_to_string(list_transform({kept}, lambda p: CASE WHEN strpos(p, '=') > 0 THEN p "
               f"ELSE p || '=' END), '&')")
    head = rx(u, r"^([^?#]*)", 1)
    frag = rx(u, r"(#.*)$", 1)
    new = f"{head} || CASE WHEN {rebuilt} = '' THEN '' ELSE '?' || {rebuilt} END || {frag}"
    return f"(CASE WHEN {has_q} AND {changed} THEN {new} ELSE {u} END)"


def url_provider(u: str) -> str:
    return rr(url_host(u), r"^www\.", "")


def target_id(href: str, base: str) -> str:
    return (f"(CASE WHEN {href} IS NULL OR {href} = '' THEN '' WHEN {href} LIKE '#%' THEN substr({href}, 2) "
            f"ELSE {rx(resolve_url(href, base), '#(.*)$', 1)} END)")


def clean_href(href: str, base: str) -> str:
    exempt = f"({href} IS NULL OR {href} = '' OR {href} LIKE 'javascript:%' OR {href} LIKE '#%')"
    return f"(CASE WHEN {exempt} THEN {href} ELSE {strip_tracking(resolve_url(href, base))} END)"


# ---------------------------------------------------------------- tokens / elements
DUCK_TOKEN_PATTERN = TOKEN_PATTERN.replace("*+", "*")
NAME_RE = r"^([^\s\"'>/=]+)"


def tokens_cte(pages: str = "pages") -> str:
    name = "lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1))"
    kind = (f"CASE WHEN tok LIKE '<!--%' THEN 'comment' WHEN tok LIKE '<!%' THEN 'doctype' "
            f"WHEN (lower(tok) LIKE '<script%' OR lower(tok) LIKE '<style%') "
            f"AND regexp_matches(lower(tok), '</(script|style)\\s*>$') THEN 'raw' "
            f"WHEN tok LIKE '</%' AND nm <> '' THEN 'close' "
            f"WHEN regexp_matches(tok, '^<[A-Za-z]') THEN CASE WHEN nm IN {inlist(VOID_TAGS)} OR tok LIKE '%/>' "
            f"THEN 'void' ELSE 'open' END ELSE 'text' END")
    raw = rf"(?is)^(<(?:{'|'.join(RAW_TEXT_TAGS)}){RAW_TEXT_OPEN.replace('*+', '*')})(.*)(</[a-z]+\s*>)$"
    piece = lambda k, r: f"{{'tok': regexp_extract(m, {q(raw)}, {k}), 'raw': {r}}}"
    parts = (f"CASE WHEN regexp_matches(m, {q(raw)}) THEN list_filter([{piece(1, 'false')}, {piece(2, 'true')}, {piece(3, 'false')}], lambda x: x.tok <> '') "
             f"ELSE [{{'tok': m, 'raw': false}}] END")
    kind = "CASE WHEN raw THEN 'text' ELSE " + kind + " END"
    return (
        f"tok_arr AS (SELECT page_id, flatten(list_transform(regexp_extract_all(coalesce(html, ''), {q(DUCK_TOKEN_PATTERN)}, 0), lambda m: {parts})) AS arr FROM {pages}),\n"
        f"tok_raw AS (SELECT page_id, (i - 1)::INTEGER AS pos, x.tok AS tok, x.raw AS raw FROM (SELECT page_id, generate_subscripts(arr, 1) AS i, unnest(arr) AS x FROM tok_arr)),\n"
        f"tok_nm AS (SELECT page_id, pos, tok, raw, {name} AS nm FROM tok_raw),\n"
        f"tok_k AS (SELECT page_id, pos, tok, nm, {kind} AS kind FROM tok_nm),\n"
        f"tokens AS (SELECT page_id, pos, kind, CASE WHEN kind IN ('open','close','void','raw') AND nm <> '' "
        f"THEN nm END AS tag, tok FROM tok_k)"
    )


def elements_cte() -> str:
    o = lambda *t: f"(kind = 'open' AND tag IN {inlist(t)})"
    c = lambda *t: f"(kind = 'close' AND tag IN {inlist(t)})"
    classes = {
        "b_block": f"(kind IN ('open','close','void') AND tag IN {inlist(BLOCK_TAGS)})",
        "b_li": f"({o('li')} OR {c('ul', 'ol', 'menu')})",
        "b_dl": f"({o('dt', 'dd')} OR {c('dl')})",
        "b_tr": f"({o('tr', 'thead', 'tbody', 'tfoot')} OR {c('table', 'thead', 'tbody', 'tfoot')})",
        "b_cell": f"({o('td', 'th', 'tr', 'thead', 'tbody', 'tfoot')} OR {c('tr', 'table', 'thead', 'tbody', 'tfoot')})",
        "b_tsec": f"({o('thead', 'tbody', 'tfoot')} OR {c('table')})",
        "b_opt": f"({o('option', 'optgroup')} OR {c('select', 'datalist', 'optgroup')})",
    }
    bounds = ", ".join(f"min(CASE WHEN {cond} THEN pos END) OVER rv AS {n}" for n, cond in classes.items())
    implied = (f"CASE WHEN tag = 'p' THEN b_block WHEN tag = 'li' THEN b_li WHEN tag IN ('dt','dd') THEN b_dl "
               f"WHEN tag = 'tr' THEN b_tr WHEN tag IN ('td','th') THEN b_cell "
               f"WHEN tag IN ('thead','tbody','tfoot') THEN b_tsec WHEN tag = 'option' THEN b_opt "
               f"WHEN tag IN {inlist(INLINE_TAGS)} THEN b_block END")
    bound = inlist(BOUND_TAGS)

    def pairs(name: str, src: str) -> str:
        return (f"{name}_rs AS (SELECT *, sum(CASE k2 WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER "
                f"(PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rs FROM {src}),\n"
                f"{name}_lv AS (SELECT *, CASE WHEN k2 = 'close' THEN rs + 1 ELSE rs END AS lvl FROM {name}_rs),\n"
                f"{name}_nx AS (SELECT *, lead(k2) OVER w AS nxt_kind, lead(pos) OVER w AS nxt_pos FROM {name}_lv "
                f"WINDOW w AS (PARTITION BY page_id, tag, lvl ORDER BY pos)),\n"
                f"{name}_sp AS (SELECT page_id, pos, nxt_pos FROM {name}_nx WHERE k2 = 'open' AND nxt_kind = 'close' AND tag IN {bound})")

    return (
        "el_in AS (SELECT *, kind AS k2 FROM tokens WHERE kind IN ('open','close','void','raw')),\n"
        + pairs("ea", "el_in") + ",\n"
        "el_x AS (SELECT DISTINCT a.page_id, a.pos FROM ea_sp a JOIN ea_sp b ON a.page_id = b.page_id AND b.pos < a.pos "
        "AND a.pos < b.nxt_pos AND b.nxt_pos < a.nxt_pos),\n"
        "el_in2 AS (SELECT i.* REPLACE (CASE WHEN x.pos IS NULL THEN k2 ELSE 'unclosed' END AS k2) FROM el_in i LEFT JOIN el_x x USING (page_id, pos)),\n"
        + pairs("eb", "el_in2") + ",\n"
        "el_ar AS (SELECT o.page_id, o.pos, min(s.nxt_pos) AS around_end FROM eb_nx o JOIN eb_sp s ON o.page_id = s.page_id "
        "AND s.pos < o.pos AND o.pos < s.nxt_pos WHERE o.kind = 'open' GROUP BY ALL),\n"
        f"el_bd AS (SELECT page_id, pos, {bounds} FROM tokens WHERE kind IN ('open','close','void') "
        "WINDOW rv AS (PARTITION BY page_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),\n"
        "el_j AS (SELECT n.*, b.* EXCLUDE (page_id, pos), r.around_end, CASE WHEN nxt_kind = 'close' THEN nxt_pos END AS own_end "
        "FROM eb_nx n LEFT JOIN el_bd b USING (page_id, pos) LEFT JOIN el_ar r USING (page_id, pos) "
        "WHERE n.kind IN ('open','void','raw')),\n"
        "el_ex AS (SELECT *, (kind <> 'open' OR coalesce(own_end <= coalesce(around_end, own_end), false)) AS explicit FROM el_j),\n"
        f"el_e AS (SELECT page_id, tag, pos AS open_pos, CASE WHEN kind <> 'open' THEN pos WHEN explicit THEN own_end "
        f"ELSE least(coalesce({implied}, 1073741824), coalesce(around_end, 1073741824)) END AS end_pos, "
        f"explicit, tok, kind AS ekind FROM el_ex),\n"
        "elements AS (SELECT *, CASE WHEN explicit THEN end_pos + 1 ELSE end_pos END AS stop_pos FROM el_e)"
    )


def attrs_cte(src: str = "elements") -> str:
    """Exploded attributes ``el_attrs(page_id, open_pos, ord, name, value)``, first occurrence only."""
    body = rr("tok", r"(?s)^<[A-Za-z][^\s/>]*|/?>$", "")
    v = rx("m", r"(?s)^[^\s\"'>/=]+\s*=\s*(.*)$", 1)
    unq = (f"CASE WHEN {v} LIKE '\"%' THEN {rx(v, '(?s)^\"(.*)\"$', 1)} "
           f"WHEN {v} LIKE '''%' THEN {rx(v, "(?s)^'(.*)'$", 1)} ELSE {v} END")
    return (
        f"at_raw AS (SELECT page_id, open_pos, generate_subscripts(ms, 1) AS ord, unnest(ms) AS m FROM "
        f"(SELECT page_id, open_pos, regexp_extract_all({body}, {q(ATTR_PATTERN)}, 0) AS ms FROM {src})),\n"
        f"at_nv AS (SELECT page_id, open_pos, ord, lower({rx('m', NAME_RE, 1)}) AS name, "
        f"{decode_entities(unq)} AS value FROM at_raw),\n"
        "el_attrs AS (SELECT * FROM at_nv QUALIFY row_number() OVER (PARTITION BY page_id, open_pos, name ORDER BY ord) = 1)"
    )




def best_srcset(x: str) -> str:
    entries = f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda e: {trim_ws('e')}), lambda e: e <> '')"
    parts = f"string_split_regex(e, {q('[' + WS + ']+')})"
    desc = f"coalesce({parts}[2], '')"
    num = rx(desc, r"([0-9.]+)(w|x)", 1)
    unit = rx(desc, r"([0-9.]+)(w|x)", 2)
    val = f"TRY_CAST(nullif({rx(num, r'^([0-9]*\.?[0-9]*)', 1)}, '') AS DOUBLE)"
    score = f"coalesce(CASE WHEN {unit} = 'w' THEN {val} WHEN {unit} = 'x' THEN {val} * 100 ELSE 1.0 END, 1.0)"
    cands = (f"list_filter(list_transform({entries}, lambda e, i: {{'score': {score}, 'neg_idx': -(i - 1), "
             f"'url': {parts}[1]}}), lambda c: c.url <> '')")
    return f"CASE WHEN len({cands}) > 0 THEN list_sort({cands}, 'DESC')[1].url END"
