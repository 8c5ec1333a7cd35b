"""Raw record files: yearly CSVs in three layouts, brought to one schema.

Fields stay text until a tolerant cast, so a bad value becomes null and never
fails a job. Rows with too many fields are dropped and rows with too few are
padded with null, whatever columns a query reads later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import dates, text

# Column names of the source files, and the record columns they feed.
STANDARD_COLUMNS = {
    "NUMERO": "case_id",
    "DATA_RECEBIMENTO": "received_at",
    "PRIORIDADE": "priority",
    "SEGREDO_JUSTICA": "sealed",
    "SERVENTIA": "unit",
    "COMARCA": "district",
    "CLASSE": "case_class",
    "ASSUNTOS": "subjects",
    "PROC_STATUS": "status",
    "AREA": "area",
    "AREA_ACAO": "action_area",
    "VALOR_CAUSA": "value",
}
# The 2014-2016 file has one field more than its header names.
LEGACY_EXTRA = "EXTRA"
# Columns the 2025 layout renamed, as new name -> standard name.
RENAMED_COLUMNS = {
    "DATA_DISTRIBUICAO": "DATA_RECEBIMENTO",
    "CODG_CLASSE": "CLASSE",
    "CODG_ASSUNTOS": "ASSUNTOS",
    "NOME_AREA_ACAO": "AREA",
}
# File name parts that select a layout, first match wins.
LEGACY_MARK = "2014"
RENAMED_MARK = "2025"
MISSING_STATUS = "N/A"

RAW_LINE = "_raw_line"
RECORD_COLUMNS = list(STANDARD_COLUMNS.values())


def _field_count(line: Column) -> Column:
    """Number of comma-separated fields, commas inside quotes not counted."""
    return F.regexp_count(F.regexp_replace(line, r'"(?:[^"]|"")*"', ""), F.lit(",")) + 1


def read_fields(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str],
    multi_line: bool = True,
) -> DataFrame:
    """CSV rows as text columns named ``columns``; over-long rows are dropped.

    The first line of every file is a header and is skipped. Spark flags rows
    with a wrong number of fields by handing over the raw line; among these only
    the over-long ones go. ``DROPMALFORMED`` would drop short rows too. Quoted
    fields may hold line ends; where none do, ``multi_line=False`` lets large files
    be split among tasks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, RAW_LINE]])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        # Names of columns that are not read may be missing from a header.
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW_LINE)
        .option("multiLine", multi_line)
        # Fields are counted against all columns, also when a query reads only some.
        .option("columnPruning", False)
        .option("escape", '"')
        .csv(path)
    )
    # Well-formed rows count as no fields; looking at their first field keeps a
    # data column in every scan, as a scan of the raw line alone is not allowed.
    unflagged = -F.length(F.coalesce(F.col(columns[0]), F.lit("")))
    fields = F.when(F.col(RAW_LINE).isNotNull(), _field_count(F.col(RAW_LINE))).otherwise(unflagged)
    return rows.filter(fields <= len(columns)).drop(RAW_LINE)


def headers_of(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """File path to the column names in its first line, for every file.

    The first block of a file is read by one task from its start, so the first row
    that an aggregate meets there is the header. One short row per file is collected.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.first("value").alias("header"))
    return {
        row.file: [name.strip().strip('"').lstrip("\ufeff").strip('"') for name in row.header.split(",")]
        for row in first.collect()
    }


def layout_of(file: str) -> str:
    """The layout that a file's name selects."""
    name = file.rsplit("/", 1)[-1]
    return "legacy" if LEGACY_MARK in name else "renamed" if RENAMED_MARK in name else "standard"


def _columns(layout: str, header: list[str], files: list[str]) -> list[str]:
    """Columns of a file by its own header; an unknown header is an error, not a loss of rows."""
    needed = [c for c in STANDARD_COLUMNS if c not in ("AREA", "AREA_ACAO", "PROC_STATUS", "VALOR_CAUSA")]
    back = {old: new for new, old in RENAMED_COLUMNS.items()}
    needed = [*[back.get(c, c) for c in needed], back["AREA"]] if layout == "renamed" else list(STANDARD_COLUMNS)
    missing = [c for c in needed if c not in header]
    if missing:
        raise ValueError(f"{', '.join(sorted(files))}: the header lacks {', '.join(missing)}")
    # The legacy file's rows have one field more than its header names.
    return [*header, LEGACY_EXTRA] if layout == "legacy" and LEGACY_EXTRA not in header else header


def to_record(raw: DataFrame, parse: str = "short") -> DataFrame:
    """Standard source columns to typed record columns; rows without a valid date are dropped."""
    parser = dates.parse_short_date if parse == "short" else dates.parse_day_first
    typed = {
        "received_at": parser(F.col("DATA_RECEBIMENTO")),
        "value": F.col("VALOR_CAUSA").try_cast("double"),
    }
    columns = [typed.get(name, F.col(source)).alias(name) for source, name in STANDARD_COLUMNS.items()]
    return raw.select(*columns).filter(F.col("received_at").isNotNull())


def legacy_record(raw: DataFrame, parse: str = "short") -> DataFrame:
    """Thirteen-field layout: repeated header rows and the extra field go."""
    rows = raw.filter(~F.col("NUMERO").eqNullSafe("NUMERO"))
    return to_record(rows.drop(LEGACY_EXTRA), parse)


def renamed_record(raw: DataFrame, parse: str = "short") -> DataFrame:
    """Renamed layout: old names restored, fields it no longer carries filled.

    Columns of the new layout that keep a standard name but are not taken from
    it are overwritten.
    """
    kept = raw.drop(*[c for c in ("AREA", "AREA_ACAO", "PROC_STATUS", "VALOR_CAUSA") if c in raw.columns])
    renamed = kept.withColumnsRenamed(RENAMED_COLUMNS)
    return to_record(
        renamed.withColumns(
            {
                "PROC_STATUS": F.lit(MISSING_STATUS),
                "AREA_ACAO": F.col("AREA"),
                "VALOR_CAUSA": F.lit(None).cast("string"),
            }
        ),
        parse,
    )


def read_records(spark: SparkSession, path: str | list[str], multi_line: bool = True, parse: str = "short") -> DataFrame:
    """All files under ``path``, each by its own header and the layout its name selects, as one table.

    Files that share layout and header are one scan, so there are as many scans as
    kinds of files. Nothing is cleaned yet: see :func:`clean_keys`.
    """
    kinds: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for file, header in headers_of(spark, path).items():
        kinds.setdefault((layout_of(file), tuple(header)), []).append(file)
    if not kinds:
        raise FileNotFoundError(f"no record files under {path}")
    normalise = {"legacy": legacy_record, "renamed": renamed_record, "standard": to_record}
    parts = []
    for (layout, header), files in sorted(kinds.items()):
        raw = read_fields(spark, sorted(files), _columns(layout, list(header), files), multi_line)
        parts.append(normalise[layout](raw, parse))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def clean_keys(records: DataFrame) -> DataFrame:
    """Drop rows without a segment, normalise segment names."""
    return records.dropna(subset=["district", "unit"]).withColumns(
        {"district": text.group_name(F.col("district")), "unit": text.strip(F.col("unit"))}
    )


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to number, unreadable text to null, then rows with any null among ``columns`` go."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns}).dropna(subset=columns)


def profile_records(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """The profiling loader: every row of all files, day-first dates, year and month added."""
    return read_records(spark, path, multi_line, "day_first").withColumns(
        {
            "year": F.year("received_at"),
            "month_no": F.month("received_at"),
            "month": dates.month_of(F.col("received_at")),
        }
    )
