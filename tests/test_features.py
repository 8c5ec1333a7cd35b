"""Hand-computed features and the properties they must keep."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import column, month, panel, series
from panelcast.operators import extended, features, ordering
from panelcast.session import durable

SHORT = [3, 1, 4, 1, 5, 9]


def test_short_series(spark):
    df = panel(spark, series(SHORT))
    assert column(extended.add_quantile_features(df), "rolling_q25_3") == [None, 3, 1.5, 2, 1, 2.5]
    assert column(extended.add_quantile_features(df), "rolling_iqr_3")[0] == 0
    assert column(features.add_rolling(df), "rolling_std_3") == [None, None, 1.41421, 1.52753, 1.73205, 2.08167]
    assert column(extended.add_local_level_slope(df), "holt_level") == [0, 3, 1, 0.5, -0.645, -0.19715]


def test_quantiles_equal_percentile(spark):
    df = panel(spark, series([(i * 7) % 13 for i in range(30)]), series([5, 5, 0, 2], unit="v"))
    for w in (3, 6, 12):
        frame = features.SeriesPast()._past(w)
        got = extended.add_quantile_features(df)
        for q in (25, 50, 75):
            expected = df.withColumn("e", F.percentile("y", q / 100).over(frame))
            assert column(got, f"rolling_q{q}_{w}") == column(expected, "e")


def test_one_row_series(spark):
    row = extended.add_all_features(panel(spark, series([7])), fill_nulls=False).first()
    assert all(row[f"lag_{k}"] is None for k in features.LAGS)
    assert (row["holt_level"], row["holt_slope"], row["is_anomaly"]) == (0, 0, 0)


def test_row_order_and_time_order(spark):
    df = panel(spark, series([1, 2, 3], unit="a"), series([4, 5, 6], unit="b"))
    by_row = extended.add_cross_sectional_features(df)
    assert column(by_row, "district_mean") == [None, 1, 1.5, 2, 2.5, 3]
    by_time = extended.add_cross_sectional_features(df, order="time")
    assert column(by_time, "district_mean") == [None, 2.5, 3, None, 2.5, 3]


@pytest.mark.parametrize("ranges", [1, 2, 5, 256])
def test_totals_before_against_brute_force(spark, ranges):
    rows = [(f"d{i % 3}", f"u{i:03d}", i, [i, None, i + 1][: 1 + i % 3]) for i in range(40)]
    df = durable(spark.createDataFrame(rows, "d string, u string, s long, t array<long>"))
    got = {
        (r["d"], r["u"]): (r["before_s"], list(r["before_t"]))
        for r in ordering.totals_before(df, ["d"], ["u"], ["s"], "t", 4, ranges).collect()
    }
    for d, u, _, _ in rows:
        earlier = sorted(r for r in rows if r[0] == d and r[1] < u)
        values = [v for r in earlier for v in r[3]]
        assert got[(d, u)] == (sum(r[2] for r in earlier), values[-4:])


def test_cross_section_with_missing_values(spark):
    """A month still to be forecast has no value; it takes a place in the row order but no weight."""
    df = panel(spark, series([1, None], unit="a"), series([4, None], unit="b"))
    assert column(extended.add_cross_sectional_features(df), "district_mean") == [None, 1, 1, 2.5]


def test_gap_year_counts_rows(spark):
    first = series(list(range(1, 13)), year=2018)
    third = series([50] * 12, year=2020)
    lagged = features.add_lags(panel(spark, first, third)).filter(F.col("month") == month(0, 2020))
    assert lagged.first()["lag_12"] == 1


def test_ungrouped_volatility(spark):
    rows = [("A", "a", month(0), 1, 2.0), ("A", "a", month(1), 1, 3.0), ("A", "b", month(0), 1, 7.0)]
    df = spark.createDataFrame(rows, "district string, unit string, month date, y long, rolling_std_3 double")
    assert column(extended.add_volatility_dynamics(df), "volatility_accel") == [0, 1, 0]
    crossed = extended.add_volatility_dynamics(df, cross_series_first_row=True)
    assert column(crossed, "volatility_accel") == [0, 1, 4]


def test_anomaly_only_after_the_spike(spark):
    flagged = extended.add_anomaly_features(panel(spark, series([4] * 9 + [90, 4, 4])))
    assert column(flagged, "is_anomaly") == [0] * 10 + [1, 0]
    assert column(flagged, "anomaly_count_6m") == [0] * 10 + [1, 1]


def test_no_anomaly_before_row_ten(spark):
    parts = [series([(3 * i * i + k * 5) % 11 + 50 * (i == k) for i in range(12)], unit=f"u{k}") for k in range(10)]
    flags = extended.add_anomaly_features(panel(spark, *parts))
    early = flags.filter(F.col("month") < month(9))
    assert early.agg(F.sum("is_anomaly")).first()[0] == 0


def test_features_do_not_see_the_present(spark):
    """Changing the value of a month changes no feature of that or earlier months."""
    values = [(5 * i) % 9 for i in range(20)]
    changed = [*values[:15], 99, *values[16:]]

    def rows(v):
        table = extended.add_all_features(panel(spark, series(v), series(values, unit="w")), order="time")
        early = table.filter(F.col("month") <= month(15)).drop("y")
        return sorted(map(str, early.collect()))

    assert rows(values) == rows(changed)


def test_fourier_phase_is_absolute(spark):
    df = extended.add_fourier_features(panel(spark, series([1], year=2015)))
    row = df.first()
    assert row["fourier_12m_sin_1"] == pytest.approx(math.sin(2 * math.pi), abs=1e-9)
    assert len(extended.FOURIER_FEATURES) == 16


def test_feature_lists():
    assert len(features.BASE_FEATURES) == 16
    assert len(extended.EXTENDED_FEATURES) == 54
    assert len(extended.MODEL_FEATURES) == 72 == len(set(extended.MODEL_FEATURES))
