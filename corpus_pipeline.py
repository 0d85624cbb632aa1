"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all
but the last return the columns of ``docs``. ``run`` applies them to the table ``documents``, writing each
stage's rows to the shared folder and reading them again, so a lost executor costs a part of one stage.

A stage's working folders are deleted when the next stage begins: its result must have been written by then.
Stages bound the bytes of the session's Arrow batches, for good: a stage's rows are made when its caller writes them.

In every stage an empty table gives an empty result with the same columns, extra columns are kept (whatever
their names), repeated rows are each judged, and a text of any length is one row. What nulls and ties mean is
said at each stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from reelflow.llm.common import Scratch, bound_batches, discard, fresh, scratch, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Working folders of the stage that ran last, by session.
_behind: dict[SparkSession, Scratch] = {}


def _tidy(step: Stage) -> Stage:
    """``step``, after the working folders of the stage before it are gone, in a session whose Arrow batches are bounded."""

    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark in _behind:
            _behind.pop(spark).clear()
        bound_batches(spark)
        with scratch(spark, keep=True) as held:
            _behind[spark] = held
            return step(spark, docs, sf_dir)

    return run_step


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def _counted(df: DataFrame, changed) -> DataFrame:
    """``df``, if it has ``n_chars``, with the length of each text that has changed."""
    if "n_chars" not in df.columns:
        return df
    kind = df.schema["n_chars"].dataType
    return df.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))


@_tidy
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has no words and goes; a null language is a stratum."""
    counts, kept = fresh(docs, "quality_counts"), fresh(docs, "kept")
    rated = stage(quality_rules.rate(docs, into=counts), "rated")
    cutoffs = quality_rules.calibrate(rated, spark.read.parquet(f"{sf_dir}/labels.parquet"), counts=counts)
    return _same_columns(quality_rules.decide(rated, cutoffs, counts=counts, into=kept).where(F.col(kept)), docs)


@_tidy
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many share; ``n_chars`` follows the text where lines went.

    A null text stays null. A row with a null id keeps its lines and counts as no document.
    """
    out = line_dedup.drop_shared_lines(docs)
    return _same_columns(_counted(out, F.col(out.columns[-1])["n_dropped"] > 0), docs)


@_tidy
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, a null id being the last.

    Texts that are null or without words have no duplicates and stay.
    """
    return ngram_join.keep_one(docs)


@_tidy
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No window of the benchmark is left: documents with a whole one go, short items are cut out of the others.

    ``n_chars`` follows the text where something was cut. A null text stays null.
    """
    cut = fresh(docs, "was_cut")
    out = decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), flag=cut)
    return _same_columns(_counted(out, F.col(cut)), docs)


@_tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what the mix takes of each: size, source_size, target, taken (or free names like these).

    A null text has size 0; a null source is the last source. Ties of keys are ordered by id, size and text.
    """
    out = mixing.mix(docs)
    m = F.col(f"`{out.columns[-1]}`")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[m[k].alias(fresh(docs, k)) for k in ("size", "source_size", "target", "taken")])


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near duplicates", one_of_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: The near-duplicate stage needs exact shingle sets and reachability over all texts, for which SQL is too slow
#: on whole tables; tests hold run() against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. The rows of a stage are deleted once the next has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
