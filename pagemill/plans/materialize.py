"""Cutting lineage of relations that several outputs reuse.

Tokens and elements feed a dozen downstream relations; without a cut,
Catalyst re-plans (and Spark re-runs) the regex tokenizer for each of them.
``materialize`` writes the relation once with a reliable ``checkpoint()``
into the cluster's ``spark.checkpoint.dir`` (so it survives executor loss;
in a session of ``page_session`` it keeps partitioning and order); ``persist`` is available for
interactive use. Never a local checkpoint.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir

CONF_KEY = "pagemill.materialize"


def materialize(df: DataFrame, how: str | None = None) -> DataFrame:
    spark = df.sparkSession
    how = how or spark.conf.get(CONF_KEY, "checkpoint")
    if how == "none":
        return df
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)
