"""URL functions (F9-F12) as Column expressions.

``resolve_url`` follows the WHATWG resolution rules for the forms that occur in
crawled pages: absolute, scheme-relative, root-relative, query-only,
fragment-only, empty and path-relative references; http(s) results get a
lower-cased host, no default port, dot segments removed and spaces / non-ASCII
characters percent-encoded. Other schemes are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.-]*:"

# Query keys removed from links (besides every ``utm_*`` key).
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref"]

# Path segments that stand for the parent and for the folder itself.
PARENT_SEGMENTS = ["..", ".%2e", "%2e.", "%2e%2e"]
CURRENT_SEGMENTS = [".", "%2e"]

# Schemes a rendered link may have (P9); links without a scheme are kept.
SAFE_SCHEMES = ["http", "https", "ftp", "ftps", "mailto", "tel", "callto", "sms", "cid", "xmpp", "matrix"]


def _let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``: a long expression stands in the plan once, not at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(u: Column, i: int) -> Column:
    return F.regexp_extract(u, URL_RE, i)


def url_host(c) -> Column:
    """Lower-cased host of an absolute URL ('' when there is none)."""
    auth = _part(_c(c), 3)
    host = F.regexp_replace(auth, r"^[^@]*@", "")
    return F.lower(F.regexp_replace(host, r":[0-9]*$", ""))


def _encode_path(p: Column) -> Column:
    """Percent-encode spaces and non-ASCII characters, leave the rest."""
    p = F.replace(p, F.lit(" "), F.lit("%20"))
    chars = F.split(p, "")
    enc = F.array_join(
        F.transform(chars, lambda ch: F.when(F.regexp_like(ch, F.lit(r"^[\x00-\x7F]*$")), ch)
                    .otherwise(F.url_encode(ch))), "")
    return F.when(F.regexp_like(p, F.lit(r"[^\x00-\x7F]")), enc).otherwise(p)


def _remove_dot_segments(path: Column) -> Column:
    return _let(path, _without_dots)


def _without_dots(path: Column) -> Column:
    """One fold over the segments: ``..`` drops the last one kept, ``.`` nothing, others are appended."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    up = lambda s: F.lower(s).isin(*PARENT_SEGMENTS)
    here = lambda s: F.lower(s).isin(*CURRENT_SEGMENTS)
    kept = F.aggregate(segments, F.lit(""), lambda acc, s: F.when(up(s), F.regexp_replace(acc, "/[^/]*$", ""))
                       .when(here(s), acc).otherwise(F.concat(acc, F.lit("/"), s)))
    last = F.element_at(segments, -1)
    folded = F.concat(kept, F.when(up(last) | here(last), F.lit("/")).otherwise(F.lit("")))
    return F.when(F.regexp_like(path, F.lit(r"(?i)(\.|%2e)(/|$)")), folded).otherwise(path)


def _normalize_http(u: Column) -> Column:
    scheme = F.lower(_part(u, 1))
    auth = _part(u, 3)
    userinfo = F.regexp_extract(auth, r"^([^@]*@)", 1)
    hostport = F.regexp_replace(auth, r"^[^@]*@", "")
    host = F.lower(F.regexp_replace(hostport, r":[0-9]*$", ""))
    port = F.regexp_extract(hostport, r":([0-9]*)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = _part(u, 4)
    path = F.when(path == "", F.lit("/")).otherwise(_remove_dot_segments(path))
    return F.concat(
        scheme, F.lit("://"), userinfo, host,
        F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        _encode_path(path), _encode_path(_part(u, 5)), _encode_path(_part(u, 6)),
    )


def resolve_url(href, base) -> Column:
    """``new URL(href, base).href``; unparsable input is returned as is."""
    h = F.regexp_replace(_c(href), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    h = F.regexp_replace(h, r"[\t\n\r]", "")
    both = F.struct(h.alias("h"), _c(base).alias("b"))
    return _let(both, lambda x: _let(_absolute(x["h"], x["b"]), _serialized))


def _serialized(absolute: Column) -> Column:
    is_http = F.lower(_part(absolute, 1)).isin("http", "https") & (_part(absolute, 2) != "")
    return F.when(is_http, _normalize_http(absolute)).otherwise(absolute)


def _absolute(h: Column, b: Column) -> Column:
    """The reference ``h`` on the base ``b``, before normalisation."""
    b_scheme, b_auth, b_path, b_query = _part(b, 1), _part(b, 3), _part(b, 4), _part(b, 5)
    b_path = F.when(b_path == "", F.lit("/")).otherwise(b_path)
    prefix = F.concat(b_scheme, F.lit("://"), b_auth)
    return (
        F.when(F.regexp_like(h, F.lit(SCHEME_RE)), h)
        .when(h.startswith("//"), F.concat(b_scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(prefix, h))
        .when(h.startswith("?"), F.concat(prefix, b_path, h))
        .when(h.startswith("#"), F.concat(prefix, b_path, b_query, h))
        .when(h == "", F.concat(prefix, b_path, b_query))
        .otherwise(F.concat(prefix, F.regexp_replace(b_path, "[^/]*$", ""), h))
    )


def strip_tracking(c) -> Column:
    """drop ``utm_*`` and the fixed tracking keys (case-insensitive) from the query.

    A query that loses a key is re-serialised (empty pairs dropped, bare keys get
    '='); an untouched query stays byte-identical; an emptied one loses its '?'.
    """
    return _let(_c(c), _stripped)


def _stripped(u: Column) -> Column:
    q = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    has_q = F.regexp_like(u, F.lit(r"^[^?#]*\?"))
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    key = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    drop = lambda p: key(p).startswith("utm_") | key(p).isin(*TRACKING_KEYS)
    kept = F.filter(pairs, lambda p: ~drop(p))
    changed = F.exists(pairs, drop)
    rebuilt = F.array_join(F.transform(kept, lambda p: F.when(F.instr(p, "=") > 0, p)
                                       .otherwise(F.concat(p, F.lit("=")))), "&")
    head = F.regexp_extract(u, r"^([^?#]*)", 1)
    frag = F.regexp_extract(u, r"(#.*)$", 1)
    new = F.concat(head, F.when(rebuilt == "", F.lit("")).otherwise(F.concat(F.lit("?"), rebuilt)), frag)
    return F.when(has_q & changed, new).otherwise(u)


def url_provider(c) -> Column:
    """host without a leading ``www.``; '' when the URL has no host."""
    return F.regexp_replace(url_host(c), r"^www\.", "")


def target_id(href, base) -> Column:
    """id a link points at: text after '#', or the fragment of the resolved URL."""
    h = _c(href)
    resolved = resolve_url(h, base)
    return (
        F.when(h.isNull() | (h == ""), F.lit(""))
        .when(h.startswith("#"), F.substring(h, 2, 1 << 30))
        .otherwise(F.regexp_extract(resolved, r"#(.*)$", 1))
    )


def clean_href(href, base) -> Column:
    """E2 href rule: empty, ``javascript:`` and ``#...`` links stay as written."""
    h = _c(href)
    exempt = h.isNull() | (h == "") | h.startswith("javascript:") | h.startswith("#")
    return F.when(exempt, h).otherwise(strip_tracking(resolve_url(h, base)))


def link_scheme(c) -> Column:
    """The scheme of a link in lower case, '' if it has none; control characters and spaces don't hide it."""
    return F.lower(F.regexp_extract(F.regexp_replace(_c(c), r"[\x00-\x20]+", ""), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def safe_src(c) -> Column:
    """The source of an image or medium if it may be rendered; else ''."""
    scheme = link_scheme(c)
    return F.when((scheme == "") | (scheme == "data") | scheme.isin(*SAFE_SCHEMES), _c(c)).otherwise(F.lit(""))


def safe_href(c) -> Column:
    """The link if it may be rendered; NULL if it is empty or has a scheme outside the allow-list."""
    h = F.regexp_replace(_c(c), r"[\x00-\x20]+", "")
    scheme = link_scheme(c)
    return F.when((h != "") & ((scheme == "") | scheme.isin(*SAFE_SCHEMES)), _c(c))
