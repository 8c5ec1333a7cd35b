"""The four steps on the smallest tables, each from what the one before wrote."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import SMALL
from panelcast.models.trees import TreeParams
from panelcast.operators import cube
from panelcast.plans import run, stages
from panelcast.sources import sinks
from panelcast.sources.tables import order_records

FEW = TreeParams(trees=4, rate=0.3, depth=3)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    run.prepare(order_records(spark, SMALL), path, stages.ORDERS)
    run.train(spark, path, stages.ORDERS, FEW, FEW)
    run.predict(spark, path, stages.ORDERS, horizon=2)
    run.publish(spark, path, stages.ORDERS)
    return path


def test_metrics_are_upserted(spark, root):
    before = run.read_metrics(spark, root)
    assert before.count() == 5
    run.store_metrics(before.filter(F.col("model") == "M4").withColumn("mae", F.lit(1.0)), root)
    after = run.read_metrics(spark, root)
    assert after.count() == 5
    assert after.filter(F.col("model") == "M4").first()["mae"] == 1.0


def test_year_filters_prune_folders(spark, root):
    plan = sinks.read_by_year(spark, f"{root}/features", 1999, 1999)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert len(list(Path(f"{root}/panel/year=1999").glob("*.parquet"))) <= sinks.FILES_PER_YEAR


def test_tables(spark, root):
    series = spark.read.parquet(f"{root}/panel").select("district", "unit").distinct().count()
    assert spark.read.parquet(f"{root}/forecast").count() == series * 2
    assert spark.read.parquet(f"{root}/predictions").count() == series * 12
    assert spark.read.json(f"{root}/report/kpis").first()["years_history"] == 7
    assert {r["bucket"] for r in spark.read.json(f"{root}/report/cube").select("bucket").distinct().collect()} == {1, 2}


def test_cube_adds_up(spark, root):
    table = spark.read.parquet(f"{root}/cube")
    leaves = table.filter(F.col("unit") != cube.ALL).agg(F.sum("actual"), F.sum("forecast")).first()
    top = table.filter(F.col("district") == cube.ALL).agg(F.sum("actual"), F.sum("forecast")).first()
    assert leaves == top
