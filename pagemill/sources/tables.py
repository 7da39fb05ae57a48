"""Table sources.

Tables are read with ``spark.read.parquet``; callers select the columns they
need right away so Catalyst prunes the scan (``html`` is only read by the
tokeniser) and pushes filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(page_id, url, html)`` plus the lower-cased ``host`` of the page URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.withColumn("host", url_host(F.col("url")))


def latest_pages(pages: DataFrame, *more: str) -> DataFrame:
    """One row for each ``page_id``: the greatest (``crawled_at`` if it is there, url, ``more``), and ``crawls``, its rows.

    Aggregated before the shuffle, so that a page crawled very often is one row from each task.
    """
    order = [*(["crawled_at"] if "crawled_at" in pages.columns else []), "url", *more]
    found = pages.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max(F.struct(*order)).alias("p"), F.count("*").alias("crawls"))
    return found.select("page_id", "p.url", *(f"p.{c}" for c in more), "crawls")
