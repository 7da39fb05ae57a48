"""Spark session defaults for page-corpus jobs.

On a cluster the session is built by the platform; ``configure`` only fills in
settings that are still unset, so cluster values (shuffle partitions,
``spark.checkpoint.dir``) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. ``requireAllClusterKeysForCoPartition=false``
# lets a join on (page_id, pos) reuse the page_id hash partitioning that the
# tokeniser already produced instead of shuffling both sides again.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # Broadcast only the rule/selector tables, which are tiny by construction;
    # everything keyed by page goes through a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # attribute maps keep the first duplicate (see operators.tokens.parse_attrs)
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A union of two page-partitioned inputs may report their partitioning,
    # but AQE can re-plan one side to another partition count and the zip
    # then fails; keep the union's partitioning unknown instead.
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in DEFAULTS.items():
        try:
            if key in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.mapKeyDedupPolicy",
                       "spark.sql.unionOutputPartitioning"):
                conf.set(key, value)
            elif conf.get(key, None) is None:
                conf.set(key, value)
        except Exception:  # static conf on a running session
            pass
    return spark


#: How page relations are planned: with fixed partition counts, so that a page's tokens, elements and intervals stay in
#: one partition through checkpoints, unions and joins. Adaptive planning would forget or change the counts. Sizes are
#: estimated from the tables that pages are built of, far below those of their tokens and elements, so only what is marked
#: with ``F.broadcast`` (rules, conditions) goes through the driver.
PAGE_PLANS = {
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    # nor does a join ask for a filter of one side's keys: each task of another pass over that side makes one of 1 MB, one
    # task merges them, and the driver puts the result in the plan, for rows that lie in the same partition anyway
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
    # the JVM leaves methods above 8000 bytes of code to its interpreter; such stages run operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # texts are collected by page or element, far more groups than the hash aggregate of objects holds before it begins
    # again with a sort, in both its phases; rows come sorted by page, so one sort is enough
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.unionOutputPartitioning": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}


def page_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for the plans of page relations: the caller's settings, then ``PAGE_PLANS``."""
    ensure_checkpoint_dir(spark)
    session = spark.newSession()
    for settings in (spark.conf.getAll, PAGE_PLANS):
        for key, value in settings.items():
            if key.startswith("spark.") and session.conf.isModifiable(key):
                session.conf.set(key, value)
    return session


def taken_over(session: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` of another session of the application, planned by this one."""
    name = f"taken_over_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    found = session.table(f"global_temp.{name}")
    session.catalog.dropGlobalTempView(name)
    return found


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and local benchmarks (UI off, no ports beyond Spark's own)."""
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagemill")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        # Local data is a few MB: AQE would fold each shuffle into 1-2
        # partitions and leave most cores idle on CPU-bound per-token work.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only a local session that names none (tests) gets a scratch folder; on a
    cluster each executor would write to its own disk, so that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="pagemill-ckpt-", dir=os.environ.get("PAGEMILL_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
