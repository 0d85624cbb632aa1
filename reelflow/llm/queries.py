"""Thin queries over the operators: whole tables in, the agreed digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.llm import decontaminate, licenses, line_dedup, mixing, ngram_join, pii, quality_rules, secrets, url_filter, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select("doc_id", *[F.col(f"quality_counts.{n}").alias(n) for n in names], "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "mixed.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    leak = F.col("leak")
    marked = decontaminate.mark(docs, benchmark).select("doc_id", "leak")
    return marked.select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        decontaminate.hit_words(leak).alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(leak).alias("contaminated"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select("doc_id", "line_counts.*")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill: the second replica has a byte changed in each record whose id's MD5 starts with two zeros."""
    pages = _table(spark, sf_dir, "pages")
    damage = F.md5(F.col("page_id").cast("string")).startswith("00")
    return warc_fixity.audited(warc_fixity.leaves(pages), warc_fixity.leaves(pages, damage))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_personal_data,
        op3_secrets,
        op4_mixing,
        op5_url_filter,
        op6_licenses,
        op7_decontamination,
        op8_line_dedup,
        op9_ngram_join,
        op10_warc_fixity,
    )
}
