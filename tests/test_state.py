"""Features from a state row are those of the whole history, at the first month and after many steps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import PANEL, panel, series
from panelcast.operators import extended, features, state
from panelcast.operators.panel import series_list
from panelcast.session import durable


def month(i):
    """The i-th month from January of 2020, which may lie before it."""
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


ORDINARY = features.CalendarRules(flag_years=())
WIDE = [*extended.NUMERIC_FEATURES, *extended.AUXILIARY_FEATURES]


def drawn(n, seed, scale=20):
    chance = random.Random(seed)
    return [chance.randrange(scale) for _ in range(n)]


def full_features(history, wide):
    """The row to come on the whole history: an empty month is added to every series."""
    last = history.agg(F.max("month")).first()[0]
    opened = F.add_months(F.lit(last), 1)
    empty = series_list(history).withColumns({"month": opened, "y": F.lit(None).cast("double")})
    rows = history.withColumn("y", F.col("y").cast("double")).unionByName(empty)
    if wide:
        table = extended.add_all_features(rows, rules=ORDINARY)
    else:
        table = extended.zero_nulls(features.add_base_features(rows, rules=ORDINARY), features.BASE_FEATURES)
    return table.filter(F.col("month") == opened)


def same(got, expected, names):
    by_key = {(r["district"], r["unit"]): r for r in expected.collect()}
    rows = got.collect()
    assert len(rows) == len(by_key)
    for row in rows:
        other = by_key[row["district"], row["unit"]]
        for name in ["month", "area_mode", *names]:
            assert row[name] == (pytest.approx(other[name], abs=1e-9) if name in names else other[name]), name


LENGTHS = (1, 2, 3, 7, 13, 40)


def ending(values, district, unit, last, area="Cível"):
    """A series whose last month is the ``last``-th of 2020."""
    return [(district, unit, month(last - len(values) + 1 + i), v, area) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def history(spark):
    parts = [ending(drawn(n, n), "AB"[n % 2], f"u{n}", 39, ("Cível", "other")[n % 3 == 0]) for n in LENGTHS]
    parts += [ending([0] * 12 + [90], "B", "spike", 39), ending([5] * 40, "A", "flat", 39)]
    return durable(panel(spark, *parts))


@pytest.mark.parametrize("wide", [False, True])
def test_next_month(spark, history, wide):
    states = durable(state.start(history))
    same(state.next_features(states, rules=ORDINARY, wide=wide), full_features(history, wide), WIDE if wide else features.BASE_FEATURES)


def test_thirteen_months_on(spark):
    """Advanced by given values, a state equals that of the longer history, and so do its features."""
    parts = {("AB"[n % 2], f"u{n}"): drawn(n + 13, n, 300) for n in LENGTHS}
    rows = {key: ending(values, *key, 39) for key, values in parts.items()}
    short = panel(spark, *[r[:-13] for r in rows.values()])
    whole = durable(panel(spark, *rows.values()))
    to_come = F.array_sort(F.collect_list(F.struct("month", "y")))
    later = whole.filter(F.col("month") > month(26)).groupBy("district", "unit").agg(to_come.alias("seen"))
    states = state.start(short).join(later, ["district", "unit"])
    for i in range(13):
        states = durable(state.advance(states, F.get("seen", F.lit(i))["y"]))
    states = states.drop("seen")
    expected = {(r["district"], r["unit"]): r for r in state.start(whole).collect()}
    for row in states.collect():
        other = expected[row["district"], row["unit"]]
        for name in ("month", "area_mode", *state.STATE):
            assert row[name] == (pytest.approx(other[name], rel=1e-12) if name in ("level", "slope") else other[name]), name
    same(state.next_features(states, rules=ORDINARY), full_features(whole, True), WIDE)


def test_missing_values_and_uneven_series(spark):
    """A missing value takes a place but no weight; a series may begin late or have gaps."""
    history = durable(
        panel(
            spark,
            series([3, None, 4, 1, None, 9, 2, 6], "A", "u"),
            [row for i, row in enumerate(series(drawn(20, 6), "A", "v")) if i not in (4, 5)],
            series([None], "C", "u"),
        )
    )
    states = durable(state.start(history))
    exact = [name for name in WIDE if not name.startswith("holt")]
    same(state.next_features(states, rules=ORDINARY), full_features(history, True), exact)


def test_no_history(spark):
    states = state.start(spark.createDataFrame([], PANEL))
    assert state.next_features(durable(states)).count() == 0


def test_states_do_not_grow(spark):
    long, short = (state.start(panel(spark, series(drawn(n, 5), year=1990))).first() for n in (13, 300))
    assert [len(short[c]) for c in ("recent", "flags", "month_totals")] == [len(long[c]) for c in ("recent", "flags", "month_totals")]
