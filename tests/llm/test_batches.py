from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelflow.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


@pytest.fixture
def largest():
    """The size of each batch; a function that workers need no import for."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return run


def long_rows(spark):
    return spark.range(40).select(F.repeat(F.lit("word "), 100_000).alias("text")).coalesce(1)


def test_staged_batches_are_bounded_in_bytes(unbounded, largest):
    df = common.stage(long_rows(unbounded).mapInArrow(common.lean(largest), "n long"), "sizes")
    assert df.agg(F.sum("n")).first()[0] >= 40 * 500_000
    assert df.agg(F.max("n")).first()[0] <= common.BATCH_BYTES + 1_000_000
    assert unbounded.conf.get(KEY, None) is None


def test_pipeline_stages_bound_what_their_caller_writes(unbounded, largest, docs, tmp_path):
    table = docs([(1, "some words"), (2, None)])
    out = corpus_pipeline.drop_lines(unbounded, table, str(tmp_path))
    sizes = long_rows(unbounded).mapInArrow(largest, "n long")
    assert sizes.agg(F.max("n")).first()[0] <= common.BATCH_BYTES + 1_000_000
    assert out.count() == 2


def test_a_bound_of_the_callers_stays(unbounded):
    unbounded.conf.set(KEY, "1000000")
    common.bound_batches(unbounded)
    assert unbounded.conf.get(KEY) == "1000000"


def test_lean_passes_rows_and_errors_on():
    assert list(common.lean(iter)([1, 2])) == [1, 2]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda rows: (1 // x for x in rows))([1, 0]))
