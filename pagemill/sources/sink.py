"""The document sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders of a document table; a host's documents share one, and a host with very many spreads over files in it.
HOST_BUCKETS = 64
#: Files of a folder, where the session has few partitions.
FILES = 8


def write_documents(docs: DataFrame, path: str, buckets: int = HOST_BUCKETS) -> None:
    """Write ``docs`` as Parquet, in a fixed number of folders by the hash of the host.

    Rows are spread by host bucket and page: each folder is written by as many
    tasks as make ``spark.sql.shuffle.partitions`` in all, ``FILES`` at least,
    whatever it holds. Readers that filter on ``host`` can
    add ``host_bucket = pmod(xxhash64(host), buckets)``.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(FILES, -(-parts // buckets))
    bucket = F.pmod(F.xxhash64("host"), F.lit(buckets)).cast("int")
    out = docs.withColumn("host_bucket", bucket)
    out = out.repartition("host_bucket", F.pmod(F.xxhash64("page_id"), F.lit(files)))
    out.write.partitionBy("host_bucket").parquet(path)
