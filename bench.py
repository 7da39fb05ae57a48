"""Benchmark: headline page-corpus queries on $BENCH_SF_DIR (default sf0.1).

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf", "pages",
"pages_per_sec", "html_mb_per_sec"}. Each query writes its whole output to the
``noop`` sink, so no column is pruned away; timings are wall-clock, one run
each after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagemill.plans.convert import Conversion  # noqa: E402
from pagemill.plans.corpus import Corpus  # noqa: E402
from pagemill.session import local_session  # noqa: E402

HEADLINE = ["convert_pages", "links", "headings", "remove_default", "tokens", "elements"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n_pages, html_bytes = pages.select(F.count("*"), F.sum(F.length("html"))).first()
    # warm-up: JVM, codegen caches
    Corpus.from_dir(spark, sf_dir).tokens.count()

    timings = {}
    for name in HEADLINE:
        t0 = time.time()
        corpus = Corpus.from_dir(spark, sf_dir)
        conv = Conversion(spark, corpus)
        df = {
            "convert_pages": lambda: conv.documents.select("page_id", "markdown"),
            "links": lambda: conv.links.select("page_id", "pos", "href_clean", "text"),
            "headings": lambda: conv.headings.select("page_id", "pos", "level", "text", "id", "slug"),
            "remove_default": lambda: conv.after_selectors.select("page_id", "pos"),
            "tokens": lambda: corpus.tokens.select("page_id", "pos"),
            "elements": lambda: corpus.elements.select("page_id", "open_pos", "end_pos"),
        }[name]()
        df.write.format("noop").mode("overwrite").save()  # every column of every row is computed
        timings[name] = round(time.time() - t0, 3)
    total = round(sum(timings.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_wall", "value": total, "unit": "sec", "queries": timings,
        "sf": float(m.group(1)) if m else None, "pages": n_pages,
        "pages_per_sec": round(n_pages / timings["convert_pages"], 1),
        "html_mb_per_sec": round(html_bytes / 1e6 / timings["convert_pages"], 3),
    }))


if __name__ == "__main__":
    main()
