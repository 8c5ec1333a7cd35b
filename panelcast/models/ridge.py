"""Global ridge regression through distributed normal equations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import TARGET
from panelcast.functions.numeric import half_even, not_negative, total
from panelcast.functions.shape import unfold
from panelcast.operators.features import BASE_FEATURES

# Penalty used for training, and the term that guards a constant feature.
PENALTY = 1e-3
SCALE_GUARD = 1e-8
BIAS = "bias"


@dataclass(frozen=True)
class RidgeModel:
    """Standardisation and coefficients; ``beta[0]`` is the bias."""

    means: tuple[float, ...]
    stds: tuple[float, ...]
    beta: tuple[float, ...]
    features: tuple[str, ...] = field(default=tuple(BASE_FEATURES))

    def forecast(self, columns: dict[str, Column] | None = None) -> Column:
        """The clipped prediction as one column expression.

        ``columns`` gives the feature values; by default the columns of that name.
        """
        values = columns or {name: F.col(name) for name in self.features}
        terms = [F.lit(self.beta[0])]
        for name, mean, std, weight in zip(self.features, self.means, self.stds, self.beta[1:]):
            scaled = (values[name].cast("double") - F.lit(mean)) / F.lit(std + SCALE_GUARD)
            terms.append(scaled * F.lit(weight))
        return not_negative(total(terms))

    def importance(self, spark: SparkSession) -> DataFrame:
        """Share of each coefficient in the sum of absolute coefficients, in percent."""
        weights = list(zip(self.features, [abs(b) for b in self.beta[1:]]))
        whole = sum(weight for _, weight in weights)
        table = spark.createDataFrame(weights, "feature string, weight double")
        return table.select("feature", half_even(F.col("weight") / F.lit(whole) * 100.0, 2).alias("importance"))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per coefficient."""
        rows = [(BIAS, None, None, self.beta[0])]
        rows += list(zip(self.features, self.means, self.stds, self.beta[1:]))
        return spark.createDataFrame(rows, "feature string, mean double, std double, beta double")

    def to_json(self) -> str:
        return json.dumps(
            {
                "features": list(self.features),
                "feature_means": list(self.means),
                "feature_stds": list(self.stds),
                "beta": list(self.beta),
            }
        )

    @staticmethod
    def from_json(text: str) -> RidgeModel:
        stored = json.loads(text)
        return RidgeModel(
            means=tuple(stored["feature_means"]),
            stds=tuple(stored["feature_stds"]),
            beta=tuple(stored["beta"]),
            features=tuple(stored["features"]),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line, written through Spark so any shared file system works."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RidgeModel:
        return RidgeModel.from_json(spark.read.text(path).first()[0])


def feature_stats(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Mean and population deviation per feature, one pass."""
    features = features or BASE_FEATURES
    wide = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in features], *[F.stddev_pop(c).alias(f"std_{c}") for c in features]
    )
    rows = [{"feature": F.lit(c), "mean": F.col(f"mean_{c}"), "std": F.col(f"std_{c}")} for c in features]
    return unfold(wide, rows)


# Number, means, what rounding cut off the means, centred products.
Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]
_MOMENTS = "n long, mean array<double>, rest array<double>, scatter array<double>"

# Tasks that merge the moments of all others before one merges theirs.
MERGERS = 32


def _merged(a: Moments | None, b: Moments) -> Moments:
    """Moments of two sets of rows taken together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], (b[1] - a[1]) + (b[2] - a[2])
    share = b[0] / n
    step = a[2] + apart * share
    mean = a[1] + step
    return n, mean, step - (mean - a[1]), a[3] + b[3] + np.outer(apart, apart) * (a[0] * share)


def _moments_row(found: Moments | None) -> Iterator[pa.RecordBatch]:
    if found is not None:
        n, mean, rest, scatter = found
        arrays = {"mean": [mean.tolist()], "rest": [rest.tolist()], "scatter": [scatter.ravel().tolist()]}
        yield pa.RecordBatch.from_pydict({"n": [n], **arrays})


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, means and centred products of one partition's rows as one row."""
    found = None
    for batch in batches:
        if batch.num_rows:
            rows = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            mean = rows.mean(axis=0)
            rows = rows - mean
            rest = rows.mean(axis=0)
            found = _merged(found, (len(rows), mean, rest, rows.T @ rows - len(rows) * np.outer(rest, rest)))
    yield from _moments_row(found)


def _merge_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, one after another, merged into one."""
    found = None
    for batch in batches:
        for row in batch.to_pylist():
            mean, rest, scatter = (np.array(row[name]) for name in ("mean", "rest", "scatter"))
            found = _merged(found, (row["n"], mean, rest, scatter.reshape(len(mean), len(mean))))
    yield from _moments_row(found)


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, mean, rest, scatter): means, and sums of products of deviations from them, in one pass over ``df``.

    Batches and tasks are merged pairwise, each around its own means, which carry along what rounding cuts
    off (``rest``), so columns far from zero lose no digits.
    Any number of tasks hands over one row each; these are merged by ``MERGERS`` tasks and theirs by one.
    No rows give no row; a null makes the entries of its column NaN.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    few = rows.mapInArrow(_partial_moments, _MOMENTS).repartition(MERGERS).mapInArrow(_merge_moments, _MOMENTS)
    return few.repartition(1).mapInArrow(_merge_moments, _MOMENTS)


def gram_matrix(
    df: DataFrame,
    features: list[str] | None = None,
    target: str = TARGET,
    scales: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Normal equations of the standardised design with bias, as (row, col, value).

    Entries are the upper triangle of X'X, and X'y under ``col = target``. They follow from the moments of
    bias, features and target, so ``df`` is read once, whether ``scales`` (mean and deviation by feature) are given or its own.
    """
    features = features or BASE_FEATURES
    names = [BIAS, *features, target]
    size = len(names)
    table = moments(df.withColumn(BIAS, F.lit(1.0)), names)

    def own_deviation(k: int) -> Column:
        return F.sqrt(F.get("scatter", F.lit(k * size + k)) / F.col("n")) + F.lit(SCALE_GUARD)

    inside = range(1, size - 1)
    if scales is None:
        centres, deviations = [F.get("mean", F.lit(k)) for k in inside], [own_deviation(k) for k in inside]
    else:
        centres, deviations = [F.lit(scales[c][0]) for c in features], [F.lit(scales[c][1] + SCALE_GUARD) for c in features]
    one = table.withColumns(
        {"centre": F.array(F.lit(0.0), *centres, F.lit(0.0)), "deviation": F.array(F.lit(1.0), *deviations, F.lit(1.0))}
    )
    cells = one.select("n", "mean", "centre", "deviation", F.posexplode("scatter").alias("place", "product"))
    label = F.array(*[F.lit(name) for name in names])
    row, col = F.floor(F.col("place") / size).cast("int"), F.col("place") % size
    offsets = [F.get("mean", at) - F.get("centre", at) for at in (row, col)]
    value = F.col("product") + F.col("n") * offsets[0] * offsets[1]
    value = value / (F.get("deviation", row) * F.get("deviation", col))
    upper = (row <= col) & (row < size - 1)
    return cells.filter(upper).select(F.get(label, row).alias("row"), F.get(label, col).alias("col"), value.alias("value"))


def fit_ridge(
    train: DataFrame, features: list[str] | None = None, target: str = TARGET, penalty: float = PENALTY
) -> RidgeModel:
    """Solve (X'X + penalty I) beta = X'y, the bias not penalised.

    The driver receives one row of moments only, a system as large as the feature list; ``train`` is read once.
    """
    features = features or BASE_FEATURES
    found = moments(train, [*features, target]).first()
    if found is None:
        raise ValueError("there are no rows to fit the model on")
    n, mean, size = found["n"], np.array(found["mean"]), len(features)
    scatter = np.array(found["scatter"]).reshape(size + 1, size + 1)
    stds = np.sqrt(np.diag(scatter)[:size] / n)
    scale = stds + SCALE_GUARD
    # Standardised features add up to zero, so the bias is an equation of its own.
    gram = scatter[:size, :size] / np.outer(scale, scale) + penalty * np.eye(size)
    weights = np.linalg.solve(gram, scatter[:size, size] / scale)
    return RidgeModel(
        means=tuple(float(m) for m in mean[:size]),
        stds=tuple(float(d) for d in stds),
        beta=(float(mean[size]), *(float(w) for w in weights)),
        features=tuple(features),
    )


# Published coefficients over the sixteen base features, in their order.
PUBLISHED = RidgeModel(
    means=(
        18.33560929913447,
        18.287319242136373,
        18.20579348743931,
        17.90621701498839,
        17.25213083175005,
        18.276240676236718,
        18.146063128914218,
        17.829996899408908,
        5.347407620446158,
        6.5,
        2.5,
        0.16666666666666666,
        0.25,
        -2.9914941744408454e-10,
        -1.116440804428724e-09,
        0.6437816656111462,
    ),
    stds=(
        93.47753403350112,
        97.86567171047226,
        98.41954711610794,
        100.29900749224,
        100.63132978646846,
        86.82881174126494,
        83.5479568492075,
        80.01628906910935,
        51.61025940315568,
        3.452052529534663,
        1.118033988749895,
        0.3726779962499649,
        0.4330127018922193,
        0.7071067815529293,
        0.7071067808201658,
        0.4788808125557804,
    ),
    beta=(
        18.35526176905214,
        30.72080904694819,
        2.518929096642842,
        11.599568820409766,
        1.9906404887614662,
        9.402312896126983,
        16.353426056746024,
        6.81328891137001,
        12.893185320057306,
        -22.97605532313868,
        -0.3069989630980002,
        -0.7836363684956164,
        -0.5303413948281696,
        -0.07384371228252198,
        -0.9965599310911045,
        -0.6599275467404775,
        -0.1253027350530755,
    ),
)
