"""Gradient-boosted trees on numeric and categorical features.

Categories enter as smoothed means of the target. A training row gets the mean of the other
folds' rows, so its own target is not in its features; rows to predict get the mean of all.
The encoding is the same for any number of values and lives in joined tables. Trees grow leaf by leaf
(:mod:`panelcast.models.leafwise`).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import KEYS, TARGET
from panelcast.functions.numeric import not_negative
from panelcast.models import leafwise
from panelcast.models.leafwise import Forest
from panelcast.models.leafwise import Growth as TreeParams
from panelcast.session import durable

FOLDS = 5
# Rows that the overall mean counts for in the mean of a category.
SMOOTHING = 20.0
# One category may hold a third of all rows; its joins are spread over so many keys.
SALTS = 16


# Parameters of the two boosted models.
BASE_TREES = TreeParams(trees=300, rate=0.05, depth=8, leaves=63, row_share=0.8, feature_share=0.8, patience=30)
EXTENDED_TREES = TreeParams(
    trees=400, rate=0.04, depth=10, leaves=95, row_share=0.75, feature_share=0.75, l1=0.5, l2=1.0, patience=50
)


def fold_of(keys: list[str]) -> Column:
    """All rows of a series are in one fold."""
    digest = F.md5(F.concat_ws("|", *keys))
    return (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % FOLDS).cast("int")


def fold_levels(rows: DataFrame, column: str, overall: float, keys: list[str], target: str = TARGET) -> DataFrame:
    """Per value and fold, the smoothed mean of the target over the other folds."""
    y = F.col(target).cast("double")
    parts = rows.groupBy(column, fold_of(keys).alias("fold")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    totals = parts.groupBy(column).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.collect_list(F.struct("fold", "s", "n")).alias("parts"))
    folds = totals.select(column, "all_s", "all_n", "parts", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))
    own = F.expr("get(filter(parts, p -> p.fold = fold), 0)")
    rest_s = F.col("all_s") - F.coalesce(own["s"], F.lit(0.0))
    rest_n = F.col("all_n") - F.coalesce(own["n"], F.lit(0))
    level = (rest_s + F.lit(SMOOTHING * overall)) / (rest_n + F.lit(SMOOTHING))
    return folds.select(column, "fold", level.alias(f"{column}_level"))


def levels(rows: DataFrame, column: str, overall: float, target: str = TARGET) -> DataFrame:
    """Per value, the smoothed mean of the target."""
    y = F.col(target).cast("double")
    level = (F.sum(y) + F.lit(SMOOTHING * overall)) / (F.count(y) + F.lit(SMOOTHING))
    return rows.groupBy(column).agg(level.alias(f"{column}_level"))


def _attach(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a table with one row per key, spread over salts on both sides."""
    salted = df.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


@dataclass
class TreeModel:
    forest: Forest
    numeric: list[str]
    categorical: list[str]
    # Column -> (value, mean target) table.
    encodings: dict[str, DataFrame] = field(default_factory=dict)
    overall: float = 0.0

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *[f"{c}_level" for c in self.categorical]]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add the categories' means; one that training never saw gets the overall mean."""
        for column, means in self.encodings.items():
            df = _attach(df, means, [column]).fillna({f"{column}_level": self.overall})
        return df

    def predict(self, df: DataFrame, name: str = "forecast") -> DataFrame:
        """Clipped prediction as a new column; categories unseen in training keep their rows."""
        scored = leafwise.with_prediction(self.prepare(df), self.forest, self.inputs, "_prediction")
        return scored.select(*df.columns, not_negative(F.col("_prediction")).alias(name))

    def importance(self, spark: SparkSession) -> DataFrame:
        """Share of the total gain per feature (as many rows as features)."""
        weights = self.forest.gains()
        rows = [(name.removesuffix("_level"), float(weight)) for name, weight in zip(self.inputs, weights)]
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        """Trees, encodings and the lists of features; :meth:`load` needs nothing else."""
        spark = None
        for column, means in self.encodings.items():
            means.write.mode("overwrite").parquet(f"{path}/encoding_{column}")
            spark = means.sparkSession
        spark = spark or SparkSession.active()
        leafwise.write(spark, self.forest, f"{path}/forest")
        about = [(self.numeric, self.categorical, float(self.overall))]
        schema = "numeric array<string>, categorical array<string>, overall double"
        spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        schema = "numeric array<string>, categorical array<string>, overall double"
        about = spark.read.schema(schema).json(f"{path}/about").first()
        encodings = {c: spark.read.parquet(f"{path}/encoding_{c}") for c in about.categorical}
        return cls(leafwise.read(spark, f"{path}/forest"), list(about.numeric), list(about.categorical), encodings, about.overall)


def category_dictionary(train: DataFrame, column: str) -> DataFrame:
    return train.select(column).distinct()


def align_categories(df: DataFrame, train: DataFrame, columns: list[str], unknown: str = "unknown") -> DataFrame:
    """Values that training never saw become ``unknown``; the rows stay."""
    for column in columns:
        seen = category_dictionary(train, column).withColumn("_seen", F.lit(True))
        df = df.join(seen, column, "left").withColumn(
            column, F.when(F.col("_seen"), F.col(column)).otherwise(F.lit(unknown))
        )
        df = df.drop("_seen")
    return df


def fit_trees(
    train: DataFrame,
    numeric: list[str],
    categorical: list[str] | None = None,
    params: TreeParams = BASE_TREES,
    validation: DataFrame | None = None,
    target: str = TARGET,
) -> TreeModel:
    """Fit on ``train``. With ``validation`` the number of trees is chosen there, by a model that has
    not seen it; then that many trees are fitted on both.

    The training rows are written once: several passes read them.
    """
    categorical = list(KEYS) if categorical is None else categorical
    needed = [*numeric, *categorical, target]
    rows = durable(train.select(*needed))
    overall = rows.agg(F.avg(target)).first()[0] or 0.0
    encodings = {c: durable(levels(rows, c, overall, target)) for c in categorical}
    model = TreeModel(None, list(numeric), categorical, encodings, overall)

    learned = rows.withColumn("fold", fold_of(categorical)) if categorical else rows
    for column in categorical:
        learned = _attach(learned, fold_levels(rows, column, overall, categorical, target), [column, "fold"])
        learned = learned.fillna({f"{column}_level": overall})
    learned = learned.select(*model.inputs, target)
    if validation is None:
        model.forest = leafwise.fit(learned, model.inputs, target, replace(params, patience=params.trees))
        return model
    held = model.prepare(validation.select(*needed)).select(*model.inputs, target)
    kept = len(leafwise.fit(learned, model.inputs, target, params, held).trees)
    both = rows.unionByName(validation.select(*needed))
    return fit_trees(both, numeric, categorical, replace(params, trees=kept), target=target)
