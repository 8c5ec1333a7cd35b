"""Recursive forecasting: each month is predicted from history and the months before it."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import AREA, KEYS, TARGET, TIME
from panelcast.functions import arrays
from panelcast.functions.numeric import half_even, not_negative
from panelcast.models import leafwise
from panelcast.models.ridge import SCALE_GUARD, RidgeModel
from panelcast.models.trees import TreeModel
from panelcast.operators import state
from panelcast.operators.extended import EPOCH_YEAR
from panelcast.operators.features import LAGS, WINDOWS, CalendarRules, area_features
from panelcast.operators.panel import series_list
from panelcast.session import durable

# Months to forecast.
HORIZON = 12
# The longest look back of the base features: the lag of twelve.
LOOK_BACK = 12


def histories(panel: DataFrame, rows: int = LOOK_BACK, keys=KEYS, time=TIME, target=TARGET) -> DataFrame:
    """One row per series: its last values in time order, its last month, its usual area."""
    cells = F.sort_array(F.collect_list(F.struct(time, F.col(target).cast("double").alias(target))))
    gathered = panel.groupBy(*keys).agg(cells.alias("_cells"), F.max(time).alias("last_month"))
    values = F.transform(arrays.last(F.col("_cells"), rows), lambda c: c[target])
    result = gathered.select(*keys, "last_month", values.alias("history"))
    return result.join(series_list(panel, keys), list(keys)) if AREA in panel.columns else result


def _whole_number(value: Column) -> Column:
    """A forecast that could not be made is null, as its value is."""
    return half_even(value, 0).cast("long").alias("forecast")


def forecast_naive(panel: DataFrame, horizon: int = HORIZON, keys=KEYS, time=TIME, target=TARGET) -> DataFrame:
    """Seasonal naive recursion. A forecast repeats the value twelve months before it, so
    month ``i`` is the history's value at the same place in its last year."""
    series = histories(panel.select(*keys, time, target), LOOK_BACK, keys, time, target)
    steps = series.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    place = (F.col("_i") - 1) % LOOK_BACK - LOOK_BACK
    rows = steps.select(
        *keys,
        F.add_months("last_month", F.col("_i")).alias(time),
        not_negative(F.try_element_at("history", place)).alias("value"),
    )
    return rows.select("*", _whole_number(F.col("value")))


def _window_mean(values: np.ndarray) -> np.ndarray:
    """Row means of the values that are there (nan where there is none)."""
    present = ~np.isnan(values)
    n = present.sum(axis=1)
    return np.divide(np.where(present, values, 0.0).sum(axis=1), n, out=np.full(len(values), np.nan), where=n > 0)


def _window_std(values: np.ndarray) -> np.ndarray:
    squares = (values - _window_mean(values)[:, None]) ** 2
    n = (~np.isnan(values)).sum(axis=1)
    return np.sqrt(np.divide(np.nansum(squares, axis=1), n - 1, out=np.full(len(values), np.nan), where=n > 1))


def _ridge_recursion(model: RidgeModel, rules: CalendarRules, horizon: int):
    """Forecast the series of an Arrow batch together, one column of values per month."""
    means, stds = np.array(model.means), np.array(model.stds) + SCALE_GUARD
    beta = np.array(model.beta)

    def features(recent: np.ndarray, month_no: np.ndarray, area_flag: np.ndarray) -> dict[str, np.ndarray]:
        angle = 2.0 * rules.pi * month_no / 12.0
        return {
            **{f"lag_{k}": recent[:, -k] for k in LAGS},
            **{f"rolling_mean_{w}": _window_mean(recent[:, -w:]) for w in WINDOWS},
            "rolling_std_3": _window_std(recent[:, -3:]),
            "month_of_year": month_no,
            "quarter": (month_no + 2) // 3,
            "is_recess": np.isin(month_no, rules.recess_months),
            "is_flag_year": np.zeros(len(month_no)),
            "month_sin": np.sin(angle),
            "month_cos": np.cos(angle),
            "area_flag": area_flag,
        }

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            values = np.full((len(frame), LOOK_BACK + horizon), np.nan)
            past = pa.compute.list_flatten(batch.column(batch.schema.get_field_index("history")))
            values[:, :LOOK_BACK] = past.to_numpy(zero_copy_only=False).reshape(len(frame), LOOK_BACK)
            frame = frame.drop(columns="history")
            month_no, area_flag = frame.pop("month_no").to_numpy(), frame.pop("area_flag").to_numpy()
            for i in range(horizon):
                known = features(values[:, i : i + LOOK_BACK], (month_no + i) % 12 + 1, area_flag)
                design = np.column_stack([known[name] for name in model.features]).astype(float)
                values[:, LOOK_BACK + i] = np.maximum((design - means) / stds @ beta[1:] + beta[0], 0.0)
            frame["values"] = list(values[:, LOOK_BACK:])
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return run


def forecast_ridge(
    panel: DataFrame,
    model: RidgeModel,
    rules: CalendarRules = CalendarRules(),
    horizon: int = HORIZON,
    keys=KEYS,
    time=TIME,
    target=TARGET,
) -> DataFrame:
    """Ridge recursion inside each series' own row: one pass, no shuffle per month.

    The features of a series need its last twelve values only. As one SQL
    expression the recursion outgrows code generation, so batches of series are
    carried through the horizon as arrays. The year flag is off, future years
    are ordinary ones. A forecast without enough history is null.
    """
    series = histories(panel, LOOK_BACK, keys, time, target)
    # Short histories are padded at the front, so that a batch is one matrix.
    missing = F.array_repeat(F.lit(None).cast("double"), F.lit(LOOK_BACK) - F.size("history"))
    padded = F.concat(missing, "history").alias("history")
    rows = series.select(
        *keys, "last_month", padded, F.month("last_month").alias("month_no"), area_features(rules)["area_flag"].alias("area_flag")
    )
    names = {k: dict(rows.dtypes)[k] for k in keys}
    schema = ", ".join([*[f"{k} {t}" for k, t in names.items()], "last_month date", "values array<double>"])
    filled = rows.mapInArrow(_ridge_recursion(model, rules, horizon), schema)
    unfolded = filled.select(*keys, "last_month", F.posexplode("values").alias("_i", "_value"))
    value = F.when(~F.isnan("_value"), F.col("_value"))
    return unfolded.select(
        *keys, F.add_months("last_month", F.col("_i") + 1).alias(time), value.alias("value"), _whole_number(value)
    )


def forecast_trees(
    panel: DataFrame,
    model: TreeModel,
    rules: CalendarRules = CalendarRules(),
    horizon: int = HORIZON,
    extended: bool = False,
    epoch_year: int = EPOCH_YEAR,
    keys=KEYS,
    time=TIME,
    target=TARGET,
) -> DataFrame:
    """Boosted-tree recursion on one state row per series: one distributed prediction per month.

    The history is read once, for the states. A month's features come from the states
    (:mod:`panelcast.operators.state`), equal to those on the whole history, as in training; the
    categories' means are joined once. Each month writes one table with a row per series,
    so lineage does not grow with the horizon and a lost executor costs one step.
    """
    rules = replace(rules, flag_years=())
    states = model.prepare(state.start(panel, keys, time, target))
    states = states.withColumn("_made", F.array().cast("array<struct<month:date,value:double>>"))
    next_month = state.NextMonth(keys, time, rules, epoch_year, extended)
    columns = states.columns
    for _ in range(horizon):
        known = next_month(durable(states))
        scored = leafwise.with_prediction(known, model.forest, model.inputs, "_p")
        scored = scored.select(*columns, not_negative(F.col("_p")).alias("_value"))
        made = F.struct(F.col(time).alias("month"), F.col("_value").alias("value"))
        scored = scored.withColumn("_made", F.concat("_made", F.array(made)))
        states = state.advance(scored, F.col("_value"), time).select(*columns)
    rows = states.select(*keys, F.explode("_made").alias("_made"))
    value = F.col("_made.value")
    return rows.select(
        *keys, F.col("_made.month").alias(time), value.alias("value"), half_even(value, 0).cast("long").alias("forecast")
    )
