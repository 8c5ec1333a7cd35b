"""Weighted blend of two forecasts and the search for its weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import TARGET
from panelcast.functions import metrics
from panelcast.functions.numeric import half_even, not_negative
from panelcast.functions.shape import unfold

# Default weight of the naive forecast, and the grid of weights.
DEFAULT_ALPHA = 0.35
GRID_STEPS = 20
GRID_STEP = 0.05


def blend_forecast(first: Column, second: Column, alpha: float = DEFAULT_ALPHA) -> Column:
    return not_negative(F.lit(alpha) * first + F.lit(1.0 - alpha) * second)


def alpha_curve(
    validation: DataFrame, first: str, second: str, target: str = TARGET, metric: str = "wmape"
) -> DataFrame:
    """Score of every weight on the grid.

    All weights are scored side by side in one aggregate, so the rows are
    neither multiplied nor read again. Pass a validation frame of your own: a
    weight tuned on the test year flatters the test score.
    """
    measure = {"wmape": metrics.wmape, "mae": metrics.mae}[metric]
    alphas = [i * GRID_STEP for i in range(GRID_STEPS + 1)]
    scores = validation.agg(
        *[
            measure(F.col(target), blend_forecast(F.col(first), F.col(second), a)).alias(f"score_{i}")
            for i, a in enumerate(alphas)
        ]
    )
    rows = [{"alpha": F.lit(round(a, 2)), "score": F.col(f"score_{i}")} for i, a in enumerate(alphas)]
    return unfold(scores, rows)


def best_alpha(curve: DataFrame) -> DataFrame:
    """The weight with the lowest score, the smaller one on ties.

    Scores are compared at nine digits: the last bits of a distributed sum
    depend on the order of its parts.
    """
    order = F.struct(F.round("score", 9), F.col("alpha"))
    return curve.agg(
        F.min_by("alpha", order).alias("alpha"), half_even(F.min_by("score", order), 3).alias("score")
    )
