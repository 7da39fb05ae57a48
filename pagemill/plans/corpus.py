"""The relations of one page corpus.

``Corpus`` takes pages to one row each, deals them out by ``page_id`` a single time and derives tokens, elements and
attributes from that. Its relations are planned by a session of their own (``session.page_session``), in which checkpoints and
unions keep that partitioning. ``page_info``, ``tokens`` and ``elements_attrs`` are written when they are first asked for.

A page may be given more than once (crawled again): the row of the latest ``crawled_at`` counts, if there is such a
column, then the one of the greatest url, then of the greatest html (so exact copies count once). Rows without
``page_id`` are no pages; ``nameless`` holds them.
"""

from __future__ import annotations

from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities
from ..functions.urls import url_host
from ..operators import tokens as T
from ..session import page_session, taken_over
from ..sources.tables import latest_pages, scan_pages
from .materialize import materialize


class Corpus:
    def __init__(self, spark: SparkSession, pages: DataFrame):
        self.spark = page_session(spark)
        self._given = taken_over(self.spark, pages)

    @classmethod
    def from_dir(cls, spark: SparkSession, sf_dir: str) -> "Corpus":
        return cls(spark, scan_pages(spark, sf_dir))

    @cached_property
    def pages(self) -> DataFrame:
        """One row ``(page_id, url, html, host)`` for each page, hash-partitioned by ``page_id`` (the only shuffle of html)."""
        return latest_pages(self._given, "html").withColumn("host", url_host(F.col("url")))

    @cached_property
    def page_info(self) -> DataFrame:
        """``(page_id, url, host, crawls)``, the rows of ``pages`` without the html; ``crawls``: the rows given for the page."""
        return materialize(latest_pages(self._given).withColumn("host", url_host(F.col("url"))))

    @cached_property
    def nameless(self) -> DataFrame:
        """``(url, host)`` of the rows without a ``page_id``."""
        return self._given.where("page_id IS NULL").select("url", url_host(F.col("url")).alias("host"))

    def heads_of(self, page_ids: DataFrame) -> "Corpus":
        """This corpus, in which the pages of ``page_ids`` hold nothing but the tags that metadata come from.

        An end tag of a title that is missing is not looked for: such a title is empty.
        """
        other = copy(self)
        for name in ("tokens", "elements", "elements_attrs", "texts"):
            other.__dict__.pop(name, None)
        marked = self.pages.join(page_ids.withColumn("_head", F.lit(True)), "page_id", "left")
        html = F.when(F.col("_head"), F.array_join(T.tags_named(F.col("html"), "title", "meta"), "")).otherwise(F.col("html"))
        other.pages = marked.withColumn("html", html).drop("_head")
        return other

    @cached_property
    def tokens(self) -> DataFrame:
        """Tokens plus decoded ``text`` of text tokens, written once."""
        t = T.tokenize(self.pages)
        t = t.withColumn("text", F.when(F.col("kind") == "text", decode_entities(F.col("tok"))))
        return materialize(t)

    @cached_property
    def elements(self) -> DataFrame:
        return T.elements(self.tokens)

    @cached_property
    def elements_attrs(self) -> DataFrame:
        """Elements with ``attrs``, ``id``, ``class`` and the page ``host``, without ``tok``, written once."""
        e = T.attributes(self.elements)
        e = e.withColumn("id", T.attr("attrs", "id")).withColumn("class", T.attr("attrs", "class"))
        e = e.join(self.page_info.select("page_id", "host"), "page_id")
        return materialize(e.drop("tok"))  # read by every later step, none of which needs the tag's text

    @cached_property
    def texts(self) -> DataFrame:
        """Text tokens with decoded character data: ``(page_id, pos, text)``."""
        return self.tokens.filter(F.col("kind") == "text").select("page_id", "pos", "text")
