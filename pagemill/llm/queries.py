"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogue, html_text, langid, licenses, mixing, neighbours, periodic, quality, simhash, substring, token_files, tokens
from .common import shared_folder, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", "n_chars")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.decide(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       digest.alias("items_sha256"), "contaminated")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = langid.identify(docs, ~langid.held_out("doc_id"))
    return rows.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` name no paths: a document lies in the directory source/language/hundred of its id."""
    docs = table(spark, sf_dir, "documents")
    parts = [F.coalesce(F.col(c), F.lit("-")) for c in ("source", "lang")]
    path = F.concat_ws("/", *parts, F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    rows = licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))
    return rows.select("doc_id", "path", "license", "cosine", "found", "folder")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.score(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.find_runs(periodic.repeating(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic.strongest(F.col("runs")).alias("best"),
                       sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", "best.*", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files go to a new folder in the shared one; they are the operator's product and stay there."""
    import public_tokenizers

    path = f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4()}"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repaired_digest(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_license_scans": op9_license_scans,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_files": op12_token_files,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The others can't be said in SQL; tests/llm holds them against brute force, the library or held-out labels.
ORACLE = {
    "op1_substring_dedup": substring.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op13_conversation_repair": dialogue.ORACLE,
}
