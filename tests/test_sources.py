"""CSV layouts, malformed rows and dates, on files written by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelcast.functions import dates
from panelcast.plans import run, stages
from panelcast.sources import records, sinks

STANDARD = list(records.STANDARD_COLUMNS)


def write(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join(r) for r in rows]]) + "\n", encoding="utf-8")


def row(case_id, date="05/03/17", **changes):
    values = dict.fromkeys(STANDARD, "x") | {"NUMERO": case_id, "DATA_RECEBIMENTO": date, "VALOR_CAUSA": "1.5"}
    return [(values | changes)[c] for c in STANDARD]


def test_field_counts(spark, tmp_path):
    write(tmp_path / "a.csv", ["a", "b", "c"], [["1", "2", "3"], ["4", "5"], ["6", "7", "8", "9"], ["1", "2", "3", ""], ['"x,y"', "2", "3"]])
    rows = records.read_fields(spark, str(tmp_path), ["a", "b", "c"])
    assert sorted(tuple(r)[:3] for r in rows.collect()) == [("1", "2", "3"), ("4", "5", None), ("x,y", "2", "3")]
    # The same rows remain when fewer columns are read.
    assert rows.select("a").count() == rows.count() == 3


def test_legacy_layout(spark, tmp_path):
    body = [[*row("1"), "extra"], [*STANDARD, "EXTRA"], [*row("2", "x"), ""], [*row("3"), ""], row("4")]
    write(tmp_path / "cases_2014_2016.csv", STANDARD, body)
    got = records.read_records(spark, str(tmp_path)).orderBy("case_id")
    assert got.columns == records.RECORD_COLUMNS
    assert [(r["case_id"], r["received_at"], r["value"]) for r in got.collect()] == [
        (c, dt.date(2017, 3, 5), 1.5) for c in ("1", "3", "4")
    ]


def test_renamed_layout(spark, tmp_path):
    back = {old: new for new, old in records.RENAMED_COLUMNS.items()}
    header = [back.get(c, c) for c in STANDARD if c not in ("PROC_STATUS", "AREA_ACAO", "VALOR_CAUSA")]
    values = [v for c, v in zip(STANDARD, row("9", "1/2/25", AREA="Criminal")) if c not in ("PROC_STATUS", "AREA_ACAO", "VALOR_CAUSA")]
    write(tmp_path / "cases_2025.csv", header, [values])
    got = records.read_records(spark, str(tmp_path)).first()
    assert (got["received_at"], got["status"], got["area"], got["action_area"], got["value"]) == (
        dt.date(2025, 2, 1),
        "N/A",
        "Criminal",
        "Criminal",
        None,
    )


def test_all_layouts_together(spark, tmp_path):
    write(tmp_path / "cases_2014_2016.csv", STANDARD, [[*row("1"), ""]])
    write(tmp_path / "cases_2020.csv", list(reversed(STANDARD)), [list(reversed(row("2", "31/12/20")))])
    write(tmp_path / "cases_2021.csv", list(reversed(STANDARD)), [list(reversed(row("3", "bad")))])
    got = records.read_records(spark, str(tmp_path))
    assert {(r["case_id"], str(r["received_at"])) for r in got.collect()} == {("1", "2017-03-05"), ("2", "2020-12-31")}


def test_every_file_by_its_own_header(spark, tmp_path):
    write(tmp_path / "cases_2020.csv", STANDARD, [row("1"), row("2")])
    write(tmp_path / "cases_2021.csv", list(reversed(STANDARD)), [list(reversed(row("3")))])
    write(tmp_path / "cases_2022.csv", STANDARD, [row("4")])
    got = records.read_records(spark, str(tmp_path))
    assert {(r["case_id"], str(r["received_at"]), r["value"]) for r in got.collect()} == {(c, "2017-03-05", 1.5) for c in "1234"}


def test_unknown_header_is_an_error(spark, tmp_path):
    write(tmp_path / "cases_2020.csv", ["NUMERO", "OTHER"], [["1", "2"]])
    with pytest.raises(ValueError, match="COMARCA"):
        records.read_records(spark, str(tmp_path))


@pytest.mark.parametrize("multi_line", [True, False])
def test_quoted_line_ends(spark, tmp_path, multi_line):
    subject = '"first\nsecond, part"' if multi_line else '"first second, part"'
    write(tmp_path / "cases_2020.csv", STANDARD, [row("1", ASSUNTOS=subject), row("2")])
    got = {r["case_id"]: r for r in records.read_records(spark, str(tmp_path), multi_line=multi_line).collect()}
    assert set(got) == {"1", "2"} and got["1"]["area"] == "x" and got["1"]["value"] == 1.5
    assert got["1"]["subjects"] == subject.strip('"')


def test_files_to_panel_keep_every_case(spark, tmp_path):
    months = [f"05/{m:02d}/{y:02d}" for y in (18, 19, 20) for m in range(1, 13)]
    body = [row(str(i), d, COMARCA=name, SERVENTIA="u") for i, d in enumerate(months) for name in ("Abc", "ABC ", "\tabc")]
    write(tmp_path / "cases_2014_2016.csv", STANDARD, [[*r, ""] for r in body[:30]])
    write(tmp_path / "cases_2019.csv", list(reversed(STANDARD)), [list(reversed(r)) for r in body[30:]])
    setup = stages.Setup(last_train_year=2019, test_year=2020, epoch_year=2018)
    run.prepare(records.read_records(spark, str(tmp_path)), str(tmp_path / "run"), setup)
    panel = sinks.read_by_year(spark, str(tmp_path / "run/panel"))
    assert {(r["district"], r["unit"]) for r in panel.collect()} == {("ABC", "u")}
    assert panel.agg(F.sum("y")).first()[0] == len(body)


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, str(tmp_path))


def test_dates(spark):
    texts = ["05/03/17", "5/3/17", "05/03/70", "05/03/2017", "xx", "29/02/00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(dates.parse_short_date(F.col("t"))).collect()] == [
        dt.date(2017, 3, 5),
        dt.date(2017, 3, 5),
        dt.date(1970, 3, 5),
        None,
        None,
        dt.date(2000, 2, 29),
        None,
    ]
    loose = df.select(dates.parse_day_first(F.col("t"))).collect()
    assert loose[3][0] == dt.date(2017, 3, 5)


def test_profile_loader(spark, tmp_path):
    write(tmp_path / "cases_2020.csv", STANDARD, [row("1", "31/12/2020"), row("2", "01/02/20")])
    write(tmp_path / "cases_2014_2016.csv", STANDARD, [[*row("3", "01/03/15"), ""]])
    write(tmp_path / "cases_2021.csv", list(reversed(STANDARD)), [list(reversed(row("4", "01/04/21")))])
    got = records.profile_records(spark, str(tmp_path))
    assert {(r["year"], r["month_no"]) for r in got.collect()} == {(2020, 12), (2020, 2), (2015, 3), (2021, 4)}


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "1"), (None, "1")], "a string, b string")
    assert [tuple(r) for r in records.coerce_numeric(df, ["a", "b"]).collect()] == [(1.0, 2.5)]


def test_yearly_partitions(spark, tmp_path):
    rows = [(dt.date(2020, 1, 1), "d", "u", 1), (dt.date(2021, 1, 1), "d", "u", 2)]
    df = spark.createDataFrame(rows, "month date, district string, unit string, y int")
    sinks.write_by_year(df, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").glob("year=*")} == {"year=2020", "year=2021"}


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    sinks.write_json(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text) == {"a": 1, "b": None}
