"""Site rules as tables.

* ``builtin_rules``   the fixed per-site rules (domain, selector, remove[]).
* rule edits are a change log ``rule_log(seq, op, domain, selector, remove)``
  with ``op`` in upsert / delete / reset; ``fold_rules`` turns the log into
  the effective rule table: the latest event per domain after the latest
  reset wins, a custom rule replaces the built-in one as a whole, and a
  deleted override lets the built-in rule show again.
* ``validate_rule_form`` normalises form input and splits off rejects.
* ``page_rule_join`` attaches the rule of each page's exact host (broadcast:
  the rule table is bounded by the number of configured sites, and its size
  is checked before broadcasting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import same
from ..functions.text import trim_ws

RULES_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("remove", T.ArrayType(T.StringType())),
])

LOG_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *RULES_SCHEMA.fields])

# Built-in site rules (domain, content selector, removals).
BUILTIN_RULES = [
    ("medium.com", "article", [".pw-highlight-menu", ".js-postShareWidget", "[aria-label='responses']"]),
    ("dev.to", "article", [".article-actions", ".comment-subscription-form", ".ltag__tag"]),
    ("stackoverflow.com", "#mainbar", [".js-post-menu", ".post-signature", ".s-aside"]),
    ("github.com", "[itemprop='text']", [".js-comment-edit-button", ".timeline-comment-actions"]),
    ("learn.microsoft.com", "main", ["#feedback-section", ".alert", "nav"]),
    ("developer.mozilla.org", "article", [".prev-next", ".language-menu", ".on-github"]),
    ("example.com", "main", ["nav", "footer", ".ads-container"]),
]

# Largest rule table broadcast to the page side; above it the join shuffles.
BROADCAST_MAX_RULES = 200_000


def builtin_rules(spark: SparkSession) -> DataFrame:
    """S5."""
    return spark.createDataFrame(BUILTIN_RULES, RULES_SCHEMA)


def latest_events(log: DataFrame) -> DataFrame:
    """``(domain, ev)``: the latest edit of each domain after the latest reset."""
    # latest reset as a one-row table joined on a constant key (scalar subquery)
    last_reset = log.filter(F.col("op") == "reset").agg(F.max("seq").alias("reset_seq")).withColumn("_k", F.lit(1))
    live = log.withColumn("_k", F.lit(1)).join(F.broadcast(last_reset), "_k", "left").drop("_k")
    live = live.filter(F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq"))).filter(F.col("op") != "reset")
    return live.groupBy("domain").agg(F.max_by(F.struct("seq", "op", "selector", "remove"), "seq").alias("ev"))


def compact_log(log: DataFrame) -> DataFrame:
    """The edits that can still matter: the latest of each domain, deletes too, and the latest reset."""
    edits = latest_events(log).select(F.col("ev.seq").alias("seq"), F.col("ev.op").alias("op"), "domain",
                                      F.col("ev.selector").alias("selector"), F.col("ev.remove").alias("remove"))
    reset = log.filter(F.col("op") == "reset").agg(F.max("seq").alias("seq")).filter("seq IS NOT NULL")
    nothing = F.lit(None).cast("string")
    reset = reset.select("seq", F.lit("reset").alias("op"), nothing.alias("domain"), nothing.alias("selector"),
                         F.lit(None).cast("array<string>").alias("remove"))
    return edits.unionByName(reset)


def fold_rules(builtin: DataFrame, log: DataFrame) -> DataFrame:
    """S6-S9 + W6: effective rules from the built-ins and an edit log."""
    latest = latest_events(log)
    custom = latest.filter(F.col("ev.op") == "upsert").select(
        "domain", F.col("ev.selector").alias("c_selector"), F.col("ev.remove").alias("c_remove"))
    b = builtin.select("domain", F.col("selector").alias("b_selector"), F.col("remove").alias("b_remove"))
    j = b.join(custom, "domain", "full_outer")
    is_custom = F.col("c_selector").isNotNull()
    return j.select(
        "domain",
        F.when(is_custom, F.col("c_selector")).otherwise(F.col("b_selector")).alias("selector"),
        F.when(is_custom, F.col("c_remove")).otherwise(F.col("b_remove")).alias("remove"),
        F.when(is_custom, F.lit("custom")).otherwise(F.lit("builtin")).alias("origin"),
    )


def validate_rule_form(form: DataFrame) -> DataFrame:
    """``form(domain, selector, remove)`` -> normalised rows with ``status``.

    Domain trimmed + lower-cased, selector trimmed, removals split by line,
    trimmed, blanks dropped; empty domain or selector -> ``rejected``.
    An empty removal list is stored as NULL (the field is omitted).
    """
    domain = F.lower(trim_ws(F.coalesce("domain", F.lit(""))))
    selector = trim_ws(F.coalesce("selector", F.lit("")))
    lines = F.filter(F.transform(F.split(F.coalesce("remove", F.lit("")), "\n"), lambda x: trim_ws(x)),
                     lambda x: x != "")
    ok = (domain != "") & (selector != "")
    keep = [c for c in form.columns if c not in ("domain", "selector", "remove")]
    return form.select(
        *keep, domain.alias("domain"), selector.alias("selector"),
        F.when(F.size(lines) > 0, lines).alias("remove"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
    )


def rules_listing(rules: DataFrame) -> DataFrame:
    """Rules by domain, removals joined by ', ', an em dash when none."""
    rm = F.array_join(F.coalesce("remove", F.array().cast("array<string>")), ", ")
    return rules.select("domain", "selector", F.when(rm == "", F.lit("—")).otherwise(rm).alias("remove_list")).orderBy("domain")


def _small(rules: DataFrame) -> bool:
    return rules.limit(BROADCAST_MAX_RULES + 1).count() <= BROADCAST_MAX_RULES


def page_rule_join(pages: DataFrame, rules: DataFrame, small: bool | None = None) -> DataFrame:
    """``pages(page_id, host, ...)`` left-joined to the rule of the exact host.

    The rule table is broadcast only when its row count is checked to be
    within ``BROADCAST_MAX_RULES``; otherwise both sides shuffle on the host.
    """
    r = rules.select("domain", "selector", "remove")
    r = F.broadcast(r) if (_small(rules) if small is None else small) else r
    return pages.join(r, same((pages["host"], r["domain"])), "left")

