"""CSS selector subset as data, matched by equi-joins.

A selector list is parsed (with Spark string functions, so rule tables can be
large) into condition rows ``(scope, rule_ord, alt, n_conds, ci, key, op, value)``:

* ``tag``            -> (``tag``, eq, tag)           ``*`` -> (``tag``, any)
* ``.c``             -> (``.``, eq, c)               ``#i`` -> (``@id``, eq, i)
* ``[a]``            -> (``@a``, exists)
* ``[a=v] [a*=v] [a^=v] [a$=v] [a~=v] [a|=v]`` -> (``@a``, eq/contains/prefix/suffix/word/dash, v)

Compound selectors (``a.b[c]``) AND their conditions; comma lists are
alternatives. Combinators and pseudo-classes are not supported: such
selectors are returned by ``quarantine`` instead of being matched.

Elements are turned into *facts* ``(key, val)`` (tag, every attribute, every
class token). Equality conditions join on ``(key, val)``; the others join on
``key`` and test the value. An element matches a selector alternative when
all of its ``n_conds`` conditions hold (a group-by on page-local keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import same
from ..functions.text import WS, trim_ws

# Selectors removed from every page before conversion, in order.
DEFAULT_REMOVE_SELECTORS = [
    "script, style, noscript",
    "header, footer, aside, nav",
    ".share, [aria-label*=share], [role=button][data-action*=share]",
    ".ads, [class*=ad-], [id*=ad-]",
    ".newsletter, .cookie, .banner, .modal",
    "[class*=popup], [class*=overlay]",
    ".comments, #comments",
    ".related, .recommended",
]

BRACKET_RE = r"""\[(?:[^\]"']|"[^"]*"|'[^']*')*\]"""
# An alternative of a selector list: a comma in brackets doesn't end it.
ALTERNATIVE_RE = rf"(?:[^,\[]+|{BRACKET_RE}|\[)+"
COMP_RE = rf"^[A-Za-z][A-Za-z0-9-]*|^\*|\.[A-Za-z0-9_-]+|#[A-Za-z0-9_-]+|{BRACKET_RE}"
ATTR_SEL_RE = (r"""^\[\s*([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s"']*)))?\s*\]$""")
OPS = {"=": "eq", "*=": "contains", "^=": "prefix", "$=": "suffix", "~=": "word", "|=": "dash"}

# Largest table of per-site conditions that is broadcast: about 100 bytes a row.
BROADCAST_MAX_CONDITIONS = 200_000

RULE_SCHEMA = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("selector", T.StringType()),
])


def default_rules(spark: SparkSession) -> DataFrame:
    """The fixed default selector list as a rule table with scope ``'*'``."""
    rows = [("*", i, s) for i, s in enumerate(DEFAULT_REMOVE_SELECTORS)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _alternatives(rules: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("selector", F.lit(ALTERNATIVE_RE), 0)
    alts = rules.select("scope", "rule_ord", F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))).alias("alt", "sel"))
    alts = alts.withColumn("sel", trim_ws(F.col("sel")))
    comps = F.regexp_extract_all(F.col("sel"), F.lit(COMP_RE), 0)
    return alts.withColumn("comps", comps).withColumn(
        "supported", (F.col("sel") != "") & (F.array_join("comps", "") == F.col("sel")))


def quarantine(rules: DataFrame) -> DataFrame:
    """Selector alternatives that use syntax outside the supported subset."""
    return _alternatives(rules).filter(~F.col("supported")).select("scope", "rule_ord", "alt", "sel")


def conditions(rules: DataFrame) -> DataFrame:
    """``rules(scope, rule_ord, selector)`` -> condition rows (see module doc)."""
    a = _alternatives(rules).filter("supported")
    c = a.select("scope", "rule_ord", "alt", F.size("comps").alias("n_conds"),
                 F.posexplode("comps").alias("ci", "comp"))
    comp = F.col("comp")
    aname = F.lower(F.regexp_extract(comp, ATTR_SEL_RE, 1))
    aop = F.regexp_extract(comp, ATTR_SEL_RE, 2)
    aval = F.concat(F.regexp_extract(comp, ATTR_SEL_RE, 3), F.regexp_extract(comp, ATTR_SEL_RE, 4),
                    F.regexp_extract(comp, ATTR_SEL_RE, 5))
    op_name = F.when(aop == "", F.lit("exists"))
    for k, v in OPS.items():
        op_name = op_name.when(aop == k, F.lit(v))
    key = (F.when(comp == "*", F.lit("tag"))
           .when(comp.startswith("."), F.lit("."))
           .when(comp.startswith("#"), F.lit("@id"))
           .when(comp.startswith("["), F.concat(F.lit("@"), aname))
           .otherwise(F.lit("tag")))
    op = (F.when(comp == "*", F.lit("any"))
          .when(comp.startswith(".") | comp.startswith("#"), F.lit("eq"))
          .when(comp.startswith("["), op_name)
          .otherwise(F.lit("eq")))
    value = (F.when(comp.startswith(".") | comp.startswith("#"), F.substring(comp, 2, 1 << 20))
             .when(comp.startswith("["), aval)
             .when(comp == "*", F.lit(None).cast("string"))
             .otherwise(F.lower(comp)))
    return c.select("scope", "rule_ord", "alt", "n_conds", "ci", key.alias("key"), op.alias("op"), value.alias("value"))


def facts(elements: DataFrame) -> DataFrame:
    """``elements(page_id, open_pos, tag, attrs, class[, host])`` -> ``(page_id, open_pos, [host,] key, val)``."""
    fact = "struct<key:string,val:string>"
    tag = F.array(F.struct(F.lit("tag").alias("key"), F.col("tag").alias("val")))
    attrs = F.transform(F.map_entries("attrs"), lambda e: F.struct(F.concat(F.lit("@"), e["key"]).alias("key"),
                                                                   e["value"].alias("val")))
    # not split(): it compiles its pattern for each row
    classes = F.transform(F.regexp_extract_all(F.coalesce(F.col("class"), F.lit("")), F.lit(f"[^{WS}]+"), 0),
                          lambda x: F.struct(F.lit(".").alias("key"), x.alias("val")))
    keep = ["page_id", "open_pos", *(["host"] if "host" in elements.columns else [])]
    # the array has a projection of its own: in generated code, while a generator interprets what it is given; "outer"
    # infers no filter on its size, which would compute it again (there is always a tag)
    held = elements.select(*keep, F.concat(tag, attrs, classes).cast(f"array<{fact}>").alias("f"))
    return held.select(*keep, F.explode_outer("f").alias("f")).select(*keep, F.col("f.key").alias("key"), F.col("f.val").alias("val"))


def _holds(op, val, value):
    words = F.split(val, f"[{WS}]+")
    return (F.when(op == "any", True).when(op == "exists", True).when(op == "eq", val == value)
            .when(op == "contains", (value != "") & (F.instr(val, value) > 0))
            .when(op == "prefix", (value != "") & val.startswith(value))
            .when(op == "suffix", (value != "") & val.endswith(value))
            .when(op == "word", F.array_contains(words, value))
            .when(op == "dash", (val == value) | val.startswith(F.concat(value, F.lit("-"))))
            .otherwise(False))


def match(fact_rows: DataFrame, conds: DataFrame, by_host: bool = False) -> DataFrame:
    """Elements matching any selector alternative -> ``(page_id, open_pos, scope, rule_ord)``.

    Fixed selectors are broadcast. With ``by_host`` the condition's ``scope``
    must equal the page host (per-site rules, as many as there are sites):
    they are broadcast if they are ``BROADCAST_MAX_CONDITIONS`` at most, else
    both sides shuffle on host and key.
    """
    from ..plans.intervals import dealt

    hint = F.broadcast if not by_host or conds.limit(BROADCAST_MAX_CONDITIONS + 1).count() <= BROADCAST_MAX_CONDITIONS else lambda x: x
    # a fact asks once with its value, for the equality conditions, and once without, for the others: it is read once
    is_eq = F.col("op") == "eq"
    c = hint(conds.withColumns({"_eq": is_eq, "_v": F.when(is_eq, F.col("value")).otherwise("")}))
    f = dealt(fact_rows, ["page_id", "open_pos", "key", "val", *(["host"] if by_host else [])],
              F.struct(F.lit(True).alias("_eq"), F.col("val").alias("_v")), F.struct(F.lit(False).alias("_eq"), F.lit("").alias("_v")))
    on = same(*[(f[k], c[k]) for k in ("key", "_eq", "_v")], *([(f["host"], c["scope"])] if by_host else []))
    sel = ["page_id", "open_pos", "scope", "rule_ord", "alt", "n_conds", "ci"]
    hits = f.join(c, on).filter(_holds(c["op"], f["val"], c["value"])).select(
        *[f[n] if n in ("page_id", "open_pos") else c[n] for n in sel])
    full = (hits.groupBy("page_id", "open_pos", "scope", "rule_ord", "alt")
            .agg(F.countDistinct("ci").alias("hit"), F.max("n_conds").alias("n"))
            .filter(F.col("hit") == F.col("n")))
    return full.select("page_id", "open_pos", "scope", "rule_ord").distinct()
