"""H5: string functions as SQL functions of a session (``SELECT slugify(text) FROM …``).

Each is a temporary function with a SQL body, so Catalyst inlines it like the Column version in ``text``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import WS, WS_CHARS, WS_NO_LF


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _each(x: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(new)})"
    return x


def _trim(x: str) -> str:
    return f"trim(BOTH {_q(WS_CHARS)} FROM {x})"


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {_q(old)}, {_q(new)})"
    return x


_UNPADDED = _each(_replaced("s", ("\r\n", "\n")), (f"^([{WS_NO_LF}]*\\n)+", ""), (f"(\\n[{WS_NO_LF}]*)+\\z", ""))

#: name -> (result type, body over the argument ``s``)
FUNCTIONS = {
    "trim_ws": ("STRING", _trim("s")),
    "squash_title": ("STRING", _trim(_each("s", (f"[{WS}]+", " ")))),
    "slugify": ("STRING", _each(_trim("lower(s)"), (f"[^A-Za-z0-9_{WS}-]", ""), (f"[{WS}_-]+", "-"), ("^-+|-+$", ""))),
    "escape_yaml": ("STRING", _replaced("s", ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))),
    "escape_info_string": ("STRING", _replaced("s", ('"', '\\"'))),
    "trim_fence_padding": ("STRING", f"CASE WHEN {_trim(_UNPADDED)} = '' THEN '' ELSE {_UNPADDED} END"),
    "footnote_label": ("STRING", _each(_trim("s"), (r"^\[|\]$", ""))),
    "int_prefix": ("INT", f"coalesce(try_cast(regexp_extract(coalesce(s, '0'), {_q(f'^[{WS}]*([+-]?[0-9]+)')}, 1) AS INT), 0)"),
    "escape_markdown_text": ("STRING", _each("s", (r"([\\*_\[\]`])", r"\\$1"))),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session, replacing those of the same name; returns their names."""
    for name, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
