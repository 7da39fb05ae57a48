"""Incremental conversion with Structured Streaming.

``stream_convert`` reads newly arriving page files (parquet) as a stream,
drops re-crawls of a URL already seen within the watermark, and converts
each micro-batch with the batch plan (``foreachBatch``), writing the
documents of a batch to a folder ``epoch=<id>`` of a parquet table, so a
replayed batch replaces what it wrote before. The stream checkpoint lives in the folder
the caller names (on a cluster: a shared location); a restarted or
recovered query resumes exactly where it stopped.

``stream_rules`` folds a rule-edit stream into the rule table the page
stream reads before each batch (stream-static: edits take effect on the
next batch, as rule edits take effect on the next conversion).

Conversion status (G3) is a column: one bad page (no html, no content, no id)
yields an ``error`` row instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.convert import Conversion, Options
from ..plans.corpus import Corpus
from ..sources import rules as R

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def with_status(docs: DataFrame, corpus: Corpus, unsupported: DataFrame) -> DataFrame:
    """``status``, ``error`` and ``crawls`` (rows given for the page); rows without an id are errors of their own.

    A page whose selectors are ``unsupported`` in part has a document all the same, made without them.
    """
    info = corpus.pages.select("page_id", (F.coalesce(F.length("html"), F.lit(0)) == 0).alias("_none"), "crawls")
    error = F.when(F.col("_none"), "page has no html").when(F.col("body") == "", "page has no content").when(
        F.col("selectors").isNotNull(), F.concat(F.lit("unsupported selector: "), F.col("selectors")))
    docs = docs.join(info, "page_id").join(unsupported, "page_id", "left").withColumn("error", error).drop("_none", "selectors")
    lost = corpus.nameless.withColumn("error", F.lit("page has no id")).withColumn("crawls", F.lit(1).cast("long"))
    docs = docs.unionByName(lost, allowMissingColumns=True)
    return docs.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def convert_batch(spark: SparkSession, pages: DataFrame, rules: DataFrame | None = None,
                  options: Options | None = None) -> DataFrame:
    """A document for each page, whatever is wrong with it (see ``with_status``); a page given more than once counts once."""
    corpus = Corpus(spark, pages)
    conv = Conversion(corpus.spark, corpus, rules, options)
    return with_status(conv.documents, corpus, conv.unsupported)


def stream_convert(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                   rules_path: str | None = None, options: Options | None = None,
                   dedup_watermark: str | None = None):
    """Start the incremental conversion; returns the ``StreamingQuery``.

    With ``dedup_watermark`` the source must carry a ``crawled_at`` timestamp;
    re-crawls of a URL inside the watermark are dropped
    (``dropDuplicatesWithinWatermark``).
    """
    schema = PAGES_SCHEMA
    if dedup_watermark:
        schema = schema.add("crawled_at", T.TimestampType())
    src = spark.readStream.schema(schema).parquet(source_dir)
    if dedup_watermark:
        src = src.withWatermark("crawled_at", dedup_watermark).dropDuplicatesWithinWatermark(["url"])

    def run(batch: DataFrame, epoch_id: int) -> None:
        rules = effective_rules(spark, rules_path) if rules_path else None
        out = convert_batch(spark, batch, rules, options)
        # keyed by epoch: a replayed batch replaces its own output
        out.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    return (src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def effective_rules(spark: SparkSession, custom_path: str) -> DataFrame:
    """Built-in rules overlaid by the latest version that ``stream_rules`` wrote (none yet: the built-ins)."""
    log = latest_version(spark, custom_path)
    if log is None:
        return R.builtin_rules(spark)
    return R.fold_rules(R.builtin_rules(spark), log).select("domain", "selector", "remove")


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rule log of the newest complete ``version=<n>`` folder (below ``before``), or None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(hadoop)]
    done = [int(n.partition("=")[2]) for n in names if n.startswith("version=")
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    return spark.read.schema(R.LOG_SCHEMA).parquet(f"{path}/version={max(done)}") if done else None


def custom_rules(spark: SparkSession, custom_path: str) -> DataFrame:
    """The live overrides ``(domain, selector, remove)`` of the latest version."""
    log = latest_version(spark, custom_path)
    if log is None:
        return spark.createDataFrame([], R.RULES_SCHEMA)
    folded = R.fold_rules(spark.createDataFrame([], R.RULES_SCHEMA), log)
    return folded.select("domain", "selector", "remove")


def stream_rules(spark: SparkSession, log_dir: str, custom_path: str, checkpoint_dir: str,
                 log_schema: T.StructType):
    """Fold each batch of rule edits into the rule log's state, one folder ``version=<epoch>`` a batch.

    The state keeps what later edits are compared with: the latest edit of
    each domain (deletes too) and the latest reset, with their ``seq``, so
    an edit that arrives late doesn't beat a newer one. A replayed batch
    writes its own version again, from the version before it.
    """
    def run(batch: DataFrame, epoch_id: int) -> None:
        events = batch.select(*R.LOG_SCHEMA.names)
        before = latest_version(spark, custom_path, before=epoch_id)
        if before is not None:
            events = before.unionByName(events)
        R.compact_log(events).write.mode("overwrite").parquet(f"{custom_path}/version={epoch_id}")

    return (spark.readStream.schema(log_schema).parquet(log_dir).writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
