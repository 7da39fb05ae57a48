"""String functions as ``Column -> Column`` expressions (JVM-side, codegen friendly).

No Python UDFs: every function here is a composition of built-in
``pyspark.sql.functions`` so it runs inside whole-stage codegen.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of JavaScript's ``trim``/``\s`` written as
# one explicit class, because Java's and RE2's ``\s`` leave out NBSP and the
# other Unicode spaces.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The members of ``WS``, for the built-in that trims without a pattern.
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Same set without the line feed (used for per-line trimming).
WS_NO_LF = r"\t\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(c) -> Column:
    """JavaScript ``String.prototype.trim`` (Unicode whitespace both ends)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def ltrim_ws(c) -> Column:
    return F.regexp_replace(_c(c), f"^[{WS}]+", "")


def squash_ws(c) -> Column:
    """F16: whitespace runs -> one space, then trim."""
    return trim_ws(F.regexp_replace(_c(c), f"[{WS}]+", " "))


def slugify(c) -> Column:
    """lower, trim, drop ``[^\\w\\s-]`` (ASCII word chars), runs of space/_/- to '-', strip edge '-'."""
    s = trim_ws(F.lower(_c(c)))
    s = F.regexp_replace(s, f"[^A-Za-z0-9_{WS}-]", "")
    s = F.regexp_replace(s, f"[{WS}_-]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def nonblank(c) -> Column:
    """Trimmed value, or NULL when null or blank (building block of F3)."""
    t = trim_ws(_c(c))
    return F.when(t != "", t)


def first_non_empty(*cols) -> Column:
    """first argument that is not null or blank, trimmed."""
    return F.coalesce(*[nonblank(c) for c in cols])


def first_non_empty_array(arr) -> Column:
    """F3 over an array column: first non-blank element, trimmed; NULL if none."""
    trimmed = F.transform(_c(arr), lambda x: trim_ws(x))
    return F.try_element_at(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")), F.lit(1))


def escape_yaml(c) -> Column:
    """escape backslash, double quote, LF, CR, tab (in that order)."""
    s = _c(c)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_info_string(c) -> Column:
    """double quote -> backslash double quote."""
    return F.replace(_c(c), F.lit('"'), F.lit('\\"'))


def normalize_markdown(c) -> Column:
    """F6 without the last step: 3+ LFs -> 2, curly quotes -> straight, NBSP -> space, trim line ends."""
    s = F.regexp_replace(_c(c), r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, "[“”]", '"')
    s = F.regexp_replace(s, "[‘’]", "'")
    s = F.regexp_replace(s, " ", " ")
    return F.regexp_replace(s, f"[{WS_NO_LF}]+(\\n|\\z)", "$1")


def post_process_markdown(c) -> Column:
    """3+ LFs -> 2, curly quotes -> straight, NBSP -> space, trim line ends, trim."""
    return trim_ws(normalize_markdown(c))


def strip_front_matter(c) -> Column:
    """split leading ``---`` ... ``---`` block from the body.

    Returns ``struct<front_matter: string, content: string>``; ``front_matter`` is
    NULL when the text does not start with ``---`` or the block is not closed.
    """
    md = _c(c)
    trimmed = ltrim_ws(md)
    lines = F.split(trimmed, r"\r?\n", -1)
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    idx = F.array_position(F.transform(rest, lambda x: trim_ws(x)), "---").cast("int")
    closed = trimmed.startswith("---") & (idx > 0)
    front = F.array_join(F.slice(lines, 1, idx + 1), "\n")
    body = trim_ws(F.array_join(F.slice(lines, idx + 2, F.greatest(F.size(lines) - idx - 1, F.lit(0))), "\n"))
    return F.struct(
        F.when(closed, front).alias("front_matter"),
        F.when(closed, body).otherwise(trim_ws(md)).alias("content"),
    )


def trim_fence_padding(c) -> Column:
    """F8: CRLF -> LF, drop leading and trailing blank lines, keep inner ones."""
    s = F.replace(_c(c), F.lit("\r\n"), F.lit("\n"))
    s = F.regexp_replace(s, f"^([{WS_NO_LF}]*\\n)+", "")
    s = F.regexp_replace(s, f"(\\n[{WS_NO_LF}]*)+\\z", "")
    return F.when(trim_ws(s) == "", F.lit("")).otherwise(s)


def footnote_label(c) -> Column:
    """trim, then remove one leading '[' and one trailing ']'."""
    return F.regexp_replace(trim_ws(c), r"^\[|\]$", "")


def int_prefix(c) -> Column:
    """``parseInt(x || '0', 10)``: leading integer, absent/unparsable -> 0."""
    n = F.regexp_extract(F.coalesce(_c(c), F.lit("0")), f"^[{WS}]*([+-]?[0-9]+)", 1)
    return F.coalesce(n.try_cast("int"), F.lit(0))


def escape_markdown_text(c) -> Column:
    """backslash-escape Markdown inline specials in text nodes."""
    return F.regexp_replace(_c(c), r"([\\*_\[\]`])", r"\\$1")


# What makes a line of text a list, rule, heading, quote or fence.
BLOCK_START = r"^([ \t]*)(-(?:[ \t-]|$)|=+[ \t]*$|>|~~~|\+(?:[ \t]|$)|#{1,6}(?:[ \t]|$))"
ORDINAL_START = r"^([ \t]*[0-9]{1,9})([.)](?:[ \t]|$))"


def escape_line_starts(c, at_start) -> Column:
    """Backslash before what would make a line of text a block; the first line only where ``at_start``."""
    md = _c(c)
    first = F.when(at_start, F.lit("")).otherwise(F.substring_index(md, "\n", 1))
    rest = F.regexp_replace(F.substring(md, F.length(first) + 1, F.length(md)), "(?md)" + BLOCK_START, r"$1\\$2")
    escaped = F.concat(first, F.regexp_replace(rest, "(?md)" + ORDINAL_START, r"$1\\$2"))
    # a single line needs the patterns only if it begins with one of their first characters
    may = F.substring(F.ltrim(md, F.lit(" \t")), 1, 1).isin(*"-=>~+#0123456789")
    return F.when(md.contains("\n") | (at_start & may), escaped).otherwise(md)


def collapse_inline_ws(c) -> Column:
    """Whitespace of HTML text outside ``pre`` collapses to one space."""
    return F.regexp_replace(_c(c), r"[ \t\n\r\f]+", " ")


def build_front_matter(title, source, author, description, retrieved) -> Column:
    """YAML block; ``source`` and ``retrieved`` are not escaped."""
    return F.concat(
        F.lit('---\ntitle: "'), escape_yaml(title),
        F.lit('"\nsource: "'), _c(source),
        F.lit('"\nretrieved: "'), _c(retrieved),
        F.lit('"\nauthor: "'), escape_yaml(author),
        F.lit('"\ndescription: "'), escape_yaml(description),
        F.lit('"\ntags: []\ntoc: true\n---'),
    )


def build_output(front_matter, toc, content) -> Column:
    """front matter, optional table of contents, rule, body."""
    t = trim_ws(F.coalesce(_c(toc), F.lit("")))
    return F.when(
        t == "", F.concat(_c(front_matter), F.lit("\n\n---\n\n"), _c(content))
    ).otherwise(
        F.concat(_c(front_matter), F.lit("\n\n## Table of Contents\n\n"), t, F.lit("\n\n---\n\n"), _c(content))
    )


def retrieved_at(ts) -> Column:
    """ISO-8601 UTC with milliseconds (session time zone must be UTC)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# A character reference, a run of other text, or a lone ampersand.
REFERENCE_OR_TEXT = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def named_characters() -> dict[str, str]:
    """The named character references of HTML 4 and XML, as the standard library lists them."""
    return {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}


def _reference(piece: Column, names: Column) -> Column:
    digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(F.lower(F.substring(piece, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when(~piece.startswith("&"), piece)
            .when(piece.startswith("&#"), F.when(good, char).otherwise(piece))
            .otherwise(F.coalesce(F.try_element_at(names, piece), piece)))


def decode_entities(c) -> Column:
    """decode numeric and named character references, each once, in one pass over the text."""
    s = _c(c)
    names = F.from_json(F.lit(json.dumps(named_characters())), "map<string,string>")
    pieces = F.regexp_extract_all(s, F.lit(REFERENCE_OR_TEXT), 0)
    out = F.array_join(F.transform(pieces, lambda p: _reference(p, names)), "")
    return F.when(F.instr(s, "&") > 0, out).otherwise(s)


def best_srcset(c) -> Column:
    """F2: URL of the highest-scored srcset candidate (first on ties); NULL if none.

    Score: the number of a ``w`` descriptor, 100x that of an ``x`` descriptor,
    else 1.
    """
    entries = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda e: trim_ws(e)),
                       lambda e: e != "")

    def cand(e, i):
        parts = F.split(e, f"[{WS}]+", 2)
        url = parts.getItem(0)
        desc = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
        num = F.regexp_extract(desc, r"([0-9.]+)(w|x)", 1)
        unit = F.regexp_extract(desc, r"([0-9.]+)(w|x)", 2)
        val = F.regexp_extract(num, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")
        score = F.when(unit == "w", val).when(unit == "x", val * 100).otherwise(F.lit(1.0))
        return F.struct(F.coalesce(score, F.lit(1.0)).alias("score"), (-i).alias("neg_idx"), url.alias("url"))

    cands = F.filter(F.transform(entries, cand), lambda x: x["url"] != "")
    return F.when(F.size(cands) > 0, F.array_max(cands)["url"])
