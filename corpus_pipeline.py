"""The corpus pipeline: ``STAGES`` in order, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, langid, mixing, simhash, substring
from pagemill.llm.common import Stored, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; a missing ``lang`` is filled in with the predicted one."""
    rows = langid.identify(docs, ~langid.held_out("doc_id")).where(F.col("lang_pred") != langid.UNKNOWN)
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (four-word shingles, four differing bits at most), the document of the smallest id stays."""
    return simhash.deduplicate(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that start anywhere else go from the texts; every document stays."""
    rows = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    rows = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return rows.where(~F.col("contaminated")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all that is left: a row for each repetition of a document."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", known_languages),
    ("SimHash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
]

#: Language ID and near-duplicates can't be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        done = Stored(stage(spark, docs, sf_dir))
        if last:
            last.drop()
        docs, last = done.read(), done
    return docs
