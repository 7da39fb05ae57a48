"""Published Markdown alternates.

``canonical_link`` finds each page's first ``link[rel=alternate][type=text/markdown]``
on the page's row, before any token is made, and resolves its href against
the page URL. ``canonical_content`` joins it with a table of crawled
alternates ``(url, status, text)``: a 2xx response whose text, after trimming
and dropping front matter (F7), is not blank replaces the converted body.
Of such pages only the tags of their metadata are tokenised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators.tokens import attr, parse_attrs, tags_named
from .tables import table


def canonical_link(pages: DataFrame) -> DataFrame:
    """``(page_id, href)`` of the first Markdown alternate link (resolved), from ``pages(page_id, url, html)``."""
    def published(attrs):
        return ((attr(attrs, "rel") == "alternate") & (attr(attrs, "type") == "text/markdown")
                & (F.coalesce(attr(attrs, "href"), F.lit("")) != ""))

    links = F.filter(F.transform(tags_named(F.col("html"), "link"), parse_attrs), published)
    first = pages.filter(F.col("html").rlike(r"(?i)<link\b")).select("page_id", "url", F.get(links, F.lit(0)).alias("attrs"))
    return first.filter(F.col("attrs").isNotNull()).select("page_id", U.resolve_url(attr("attrs", "href"), F.col("url")).alias("href"))


def canonical_content(links: DataFrame, alternates: DataFrame) -> DataFrame:
    """``(page_id, content)`` for pages whose alternate is usable."""
    a = alternates.filter((F.col("status") >= 200) & (F.col("status") <= 299)).select(
        F.col("url").alias("href"), "text")
    j = links.join(a, "href")
    body = X.trim_ws(X.strip_front_matter(X.trim_ws(F.coalesce("text", F.lit(""))))["content"])
    j = j.select("page_id", body.alias("content")).filter(F.col("content") != "")
    w = Window.partitionBy("page_id").orderBy("content")
    return j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def crawled_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternates table derived from ``supplier``: one Markdown file per row,
    some failing (404), some blank, some with front matter."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://site"), (k % 7).cast("string"), F.lit(".example.org/"),
                   F.when(k % 3 == 1, F.concat(F.lit("d/md/"))).otherwise(F.lit("md/")), k.cast("string"), F.lit(".md"))
    status = F.when(k % 5 == 4, F.lit(404)).otherwise(F.lit(200))
    text = (F.when(k % 4 == 0, F.concat(F.lit("---\ntitle: Doc "), k.cast("string"), F.lit("\n---\n\n# Doc "),
                                         k.cast("string"), F.lit("\n\n"), F.col("s_name"), F.lit("\n")))
            .when(k % 4 == 1, F.lit("   \n "))
            .when(k % 4 == 2, F.concat(F.lit("---\nunclosed: "), k.cast("string"), F.lit("\n"), F.col("s_name")))
            .otherwise(F.concat(F.lit("  # Plain "), k.cast("string"), F.lit("  "))))
    return s.select(url.alias("url"), status.alias("status"), text.alias("text"))
