"""A whole run as four steps that hand over written tables.

Every step reads what the one before wrote, so a failed step is repeated alone
and training or forecasting never goes back to the raw records. ``root`` is a
folder all executors share.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import AREA, KEYS, TARGET, TIME
from panelcast.functions.numeric import half_even
from panelcast.models import blend, forecast, ridge, trees
from panelcast.operators import cube, extended, features, panel, profile, reports, split
from panelcast.plans.stages import Setup, full_features, with_forecasts
from panelcast.session import durable
from panelcast.sources import sinks
from panelcast.sources.records import clean_keys


def prepare(records: DataFrame, root: str, setup: Setup, grid: str = "observed") -> None:
    """Records to the dense panel, the feature table and the summaries.

    Raw records are read once: typed and with clean names they are written, and all else
    starts from there.
    """
    spark = records.sparkSession
    clean_keys(records).write.mode("overwrite").parquet(f"{root}/records")
    records = spark.read.parquet(f"{root}/records")
    panel.monthly_counts(records).write.mode("overwrite").parquet(f"{root}/sparse")
    sparse = spark.read.parquet(f"{root}/sparse")
    sinks.write_by_year(panel.zero_fill(sparse, grid=grid), f"{root}/panel")
    dense = sinks.read_by_year(spark, f"{root}/panel")
    sinks.write_by_year(full_features(dense, setup), f"{root}/features")
    table = sinks.read_by_year(spark, f"{root}/features")
    split.assert_no_leakage(split.drop_warmup(table), setup.last_train_year, setup.test_year)
    sinks.write_json(split.split_summary(table, setup.last_train_year, setup.test_year), f"{root}/summary/split")
    sinks.write_json(panel.sparsity(sparse, dense), f"{root}/summary/sparsity")
    sinks.write_json(profile.summary(records), f"{root}/summary/records")


def _part(spark: SparkSession, root: str, first: int | None, last: int | None) -> DataFrame:
    table = sinks.read_by_year(spark, f"{root}/features", first, last)
    return extended.zero_nulls(split.drop_warmup(table), extended.NUMERIC_FEATURES)


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of the metrics table that were written to their end, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root}/metrics")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder)]
    return sorted(p.toString() for p in found if files.exists(hadoop.Path(p, "_SUCCESS")))


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(_versions(spark, root)[-1])


def store_metrics(new: DataFrame, root: str) -> None:
    """Upsert into the metrics table by writing its next version; readers take the newest whole one."""
    spark = new.sparkSession
    versions = _versions(spark, root)
    old = spark.read.parquet(versions[-1]) if versions else new.limit(0)
    reports.upsert_metrics(old, new).write.parquet(f"{root}/metrics/{len(versions):08d}-{uuid.uuid4().hex}")


def train(
    spark: SparkSession,
    root: str,
    setup: Setup,
    base_trees: trees.TreeParams = trees.BASE_TREES,
    extended_trees: trees.TreeParams = trees.EXTENDED_TREES,
) -> trees.TreeModel:
    """Fit all models, store them with their scores and the predictions of the test year.

    The weight of the blend and the number of trees are chosen on the last
    training year, not on the test year. Returns the extended tree model.
    """
    train_rows = _part(spark, root, None, setup.last_train_year)
    test_rows = _part(spark, root, setup.test_year, setup.test_year)
    earlier = _part(spark, root, None, setup.last_train_year - 1)
    last = _part(spark, root, setup.last_train_year, setup.last_train_year)
    trial = with_forecasts(last, ridge.fit_ridge(earlier), setup.alpha)
    alpha = blend.best_alpha(blend.alpha_curve(trial, "m0", "m1")).first()["alpha"]
    linear = ridge.fit_ridge(train_rows)
    linear.save(spark, f"{root}/models/ridge")
    narrow = trees.fit_trees(earlier, features.BASE_FEATURES, params=base_trees, validation=last)
    wide = trees.fit_trees(earlier, extended.NUMERIC_FEATURES, params=extended_trees, validation=last)
    narrow.save(f"{root}/models/trees")
    wide.save(f"{root}/models/trees_extended")
    sinks.write_csv(reports.largest(wide.importance(spark), 20, "importance", ["feature"]), f"{root}/importance")

    scored = durable(wide.predict(narrow.predict(with_forecasts(test_rows, linear, alpha), "m3"), "m4"))
    table = reports.predictions_table(scored, F.col("m0"), F.col("m1"), F.col("m2"))
    more = scored.select(*KEYS, TIME, half_even(F.col("m3"), 1).alias("trees"), half_even(F.col("m4"), 1).alias("trees_extended"))
    reports.attach_predictions(table, more).write.mode("overwrite").parquet(f"{root}/predictions")
    names = {f"M{i}": f"m{i}" for i in range(5)}
    store_metrics(reports.metrics_by_model(scored, names, str(setup.test_year)), root)
    return wide


def predict(
    spark: SparkSession, root: str, setup: Setup, model: trees.TreeModel | None = None, horizon: int = forecast.HORIZON
) -> None:
    """Forecast beyond the history with the extended trees, by default those that :func:`train` stored."""
    model = model or trees.TreeModel.load(spark, f"{root}/models/trees_extended")
    dense = sinks.read_by_year(spark, f"{root}/panel")
    rules = replace(setup.rules, flag_years=())
    ahead = forecast.forecast_trees(dense, model, rules, horizon, extended=True, epoch_year=setup.epoch_year)
    ahead.write.mode("overwrite").parquet(f"{root}/forecast")


def publish(spark: SparkSession, root: str, setup: Setup) -> None:
    """Accuracy tables, indicators, the cube and its documents."""
    predictions = spark.read.parquet(f"{root}/predictions")
    dense = sinks.read_by_year(spark, f"{root}/panel").select(*KEYS, TIME, TARGET, AREA)
    ahead = spark.read.parquet(f"{root}/forecast")
    best = "trees_extended"
    summary = reports.segment_summary(predictions, best)
    sinks.write_csv(summary, f"{root}/report/segments")
    sinks.write_csv(reports.unit_table(predictions, best), f"{root}/report/units")
    sinks.write_csv(reports.accuracy_bands(summary), f"{root}/report/bands")
    sinks.write_csv(reports.forecast_totals(ahead), f"{root}/report/forecast_totals")
    sinks.write_json(reports.kpis(predictions, dense, best, setup.test_year), f"{root}/report/kpis")
    sinks.write_json(reports.holdout_metrics(predictions, best), f"{root}/report/holdout")
    sinks.write_json(cube.hierarchy_documents(dense), f"{root}/report/hierarchy")
    until = dense.agg(F.max(TIME)).first()[0]
    # The forecast table says how far it reaches.
    first, last = ahead.agg(F.min(TIME), F.max(TIME)).first()
    tested = predictions.select(*KEYS, TIME, half_even(F.col(best), 0).cast("long").alias("forecast"))
    months = (split.month_date(setup.test_year, 1), split.month_date(setup.test_year, 12))
    table = cube.forecast_cube(
        dense,
        tested.unionByName(ahead.select(*KEYS, TIME, "forecast")),
        setup.cube_first_year,
        last.year,
        until,
        [months, (first, last)],
    )
    sinks.write_cube_table(table, f"{root}/cube")
    sinks.write_cube(cube.cube_documents(sinks.read_cube_table(spark, f"{root}/cube")), f"{root}/report/cube")
    documents = spark.read.schema("district string, unit string, document string, bucket int").json(f"{root}/report/cube")
    sinks.write_cube_tree(cube.cube_tree(documents), f"{root}/report/tree")
