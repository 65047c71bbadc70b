"""Every query over the reference operators against its SQL, or for rows where SQL can't say."""

import pytest

from tessella.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, data, agree):
    agree(QUERIES[name](spark, data), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_plan_is_one_pruned_scan(spark, data):
    plan = QUERIES["it34_cells_to_he"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "p_name" not in plan.split("ReadSchema")[1]


def test_crop_reaches_the_scan(spark, tmp_path):
    from tessella.operators.raster import crop

    spark.range(1000).selectExpr("id div 40 as y", "id % 40 as x", "id as v").write.parquet(str(tmp_path / "r"))
    plan = crop(spark.read.parquet(str(tmp_path / "r")), 3, 4, 5, 6)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y,4)" in plan
