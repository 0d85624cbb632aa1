"""Every query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

import oracle_check
import pytest

from reelflow import catalogue, views


@pytest.fixture(scope="module")
def con(sf):
    return oracle_check.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, con, name):
    oracle_check.compare(catalogue.QUERIES[name](spark, sf), catalogue.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["video_id", "out_idx", "frame_idx", "pts"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_slice_of_a_key_is_pruned_in_the_scan(spark, sf):
    plan = views.packets(spark, sf).where("video_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan
    assert "props" not in plan


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["q09_frame_at_index", "q10_slice"])
def test_many_views_of_an_index_share_it(spark, sf, name):
    plan = planned(catalogue.QUERIES[name](spark, sf))
    assert plan.count("FileScan") == 1
    assert not any(x in plan for x in ("Union", "Join", "HashAggregate"))


def test_an_index_of_shipments_takes_two_sorts_and_no_hash_table(spark, sf):
    plan = catalogue.QUERIES["q05b_frame_index_long"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and "HashAggregate" not in plan
