import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import local_session
    s = local_session(4)
    yield s


@pytest.fixture(scope="session")
def convert(spark):
    """Build a Conversion over in-memory pages: ``convert([(id, url, html), ...])``."""
    from pyspark.sql import functions as F

    from pagemill.functions.urls import url_host
    from pagemill.plans.convert import Conversion, Options
    from pagemill.plans.corpus import Corpus

    def run(rows, rules=None, **opts):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        df = df.withColumn("host", url_host(F.col("url")))
        return Conversion(spark, Corpus(spark, df), rules, Options(**opts) if opts else None)
    return run
