"""CSV and parquet tables: panels, cases, traps, populations, yearly sheets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import nan_to_null
from ..operators.columns import rename_by_position

# Names of the sheet columns, by position.
SHEET_NAMES = {
    **{3 + 2 * (m - 1): f"Infection_{m}" for m in range(1, 13)},
    **{4 + 2 * (m - 1): f"Death_{m}" for m in range(1, 13)},
    27: "Total_Infections",
    28: "Total_Death",
    29: "Incidence_Rate",
    31: "Population",
}
MAX_SHEETS = 14

POPULATION_COLUMNS = ("CODEBASE", "P_CNT", "M_CNT", "F_CNT")
ROC_OFFSET = 1911

CASE_COLUMNS = {
    "onset": "onset", "imported": "imported", "county": "county", "town": "town", "zone_id": "zone_id",
}
TRAP_COLUMNS = {
    "StartTime": "start_time", "X": "x", "Y": "y", "District": "district", "AvgEggs": "avg_eggs",
}

# A file that Spark wrote as part of a table; the table's name is that of its folder.
_PART_FILE = r"^part-\d{5}-[0-9a-f]{8}-"


def _file_name() -> Column:
    """Name of the row's file, or of its folder where Spark wrote the file as one."""
    plain = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    path = F.split(plain, "/")
    last = F.element_at(path, -1)
    return F.when(last.rlike(_PART_FILE), F.element_at(path, -2)).otherwise(last)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """CSV files below ``path``: ``path, ok`` (all lines are valid UTF-8), ``header`` (128 bits of the first line's hash).

    Longs and booleans fit Spark's hash aggregate, which holds one row for each file; with texts as
    values it would sort all lines of a task first.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.is_valid_utf8("value").alias("ok"),
            F.xxhash64("value").alias("a"),
            F.xxhash64(F.lit(1), "value").alias("b"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    first = F.struct(*[F.min_by(h, "place").alias(h) for h in ("a", "b")])
    return lines.groupBy("path").agg(F.bool_and("ok").alias("ok"), first.alias("header"))


def _same_headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """CSV files below ``path`` in groups of one encoding and header: (encoding, paths).

    A file is big5 where some line is not valid UTF-8. One scan looks at all files; only their
    names reach the driver, which lists them for the scans anyway.
    """
    groups = _files(spark, path).groupBy("ok", "header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [("utf-8" if g["ok"] else "big5", g["paths"]) for g in groups.orderBy(F.desc("ok"), "paths").collect()]


def _scans(spark: SparkSession, path: str) -> list[DataFrame]:
    """One scan for each encoding and header below ``path``, all columns as text under their own names."""
    found = _same_headers(spark, path)
    if not found:
        raise ValueError(f"no CSV files below {path}")
    return [spark.read.option("header", True).option("encoding", e).csv(paths) for e, paths in found]


def read_table_dir(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All CSV files below a directory, each row tagged with its lower-cased file stem.

    Columns are found by name. Files may have different columns: those of ``schema`` that a
    file lacks are NULL in its rows, and columns not in ``schema`` are left out.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    stem = F.lower(F.split(_file_name(), r"\.")[0]).alias("source_name")
    parts = []
    for rows in _scans(spark, path):
        typed = [
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in fields
        ]
        parts.append(rows.select(*typed, stem))
    return nan_to_null(reduce(DataFrame.unionByName, parts))


def _by_name(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """Columns of CSV files under the library's names, in any order and beside any others."""
    parts = []
    for rows in _scans(spark, path):
        absent = [n for n in names if n not in rows.columns]
        if absent:
            raise ValueError(f"{path} has no columns {absent}, but {rows.columns}")
        parts.append(rows.select(*[F.col(f"`{n}`").alias(ours) for n, ours in names.items()]))
    return reduce(DataFrame.unionByName, parts)


def read_cases(spark: SparkSession, path: str, names: Mapping[str, str] = CASE_COLUMNS) -> DataFrame:
    """Case line-list; the onset is text like 2023/7/1, unreadable dates give NULL.

    ``names`` maps the file's columns to the library's; the first is the onset. Columns are
    found by name, and one that is absent raises.
    """
    cases = _by_name(spark, path, names)
    onset = next(iter(names.values()))
    return cases.withColumn(onset, F.try_to_date(onset, "yyyy/M/d"))


def read_traps(spark: SparkSession, path: str, names: Mapping[str, str] = TRAP_COLUMNS) -> DataFrame:
    """Trap observations: ``start_time, x, y, district, avg_eggs``, found by the file's names for them."""
    traps = _by_name(spark, path, names).withColumns(
        {
            "start_time": F.try_to_timestamp("start_time"),
            **{c: F.col(c).try_cast("double") for c in ("x", "y", "avg_eggs")},
        }
    )
    return nan_to_null(traps)


def read_population_by_year(spark: SparkSession, root: str) -> DataFrame:
    """Populations of all CSV files below ``root``: ``year, zone_id, p_cnt, m_cnt, f_cnt``.

    The digits before 年 in the file name plus 1911 give the year. There is one scan for each
    encoding (UTF-8 or big5) and header, however many files there are. Counts stay text. Files
    in big5 need the session setting ``spark.sql.legacy.javaCharsets`` (``session.prepare``).
    """
    digits = F.regexp_replace(F.split(_file_name(), "年")[0], r"\D", "")
    parts = [
        rows.select(
            (digits.cast("int") + ROC_OFFSET).alias("year"),
            F.col(POPULATION_COLUMNS[0]).alias("zone_id"),
            *[F.col(c).alias(c.lower()) for c in POPULATION_COLUMNS[1:]],
        )
        for rows in _scans(spark, root)
    ]
    return reduce(DataFrame.unionByName, parts)


def read_yearly_sheets(spark: SparkSession, paths: Mapping[int, str], most: int = MAX_SHEETS) -> DataFrame:
    """One exported sheet per year, columns named by position, in one table with ``year``.

    Each export starts with a ``row_no`` column (1 for the first data row), so that the
    heading row is left out by a filter and not by file order.
    """
    if len(paths) > most:
        raise ValueError(f"more than {most} sheets cannot be mapped to years")
    parts = []
    for year in sorted(paths):
        sheet = spark.read.option("header", True).csv(paths[year])
        body = rename_by_position(
            sheet, {0: "row_no", **{p + 1: n for p, n in SHEET_NAMES.items()}}
        )
        parts.append(
            body.withColumn("row_no", F.col("row_no").cast("int"))
            .where("row_no > 1")
            .withColumn("year", F.lit(int(year)))
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
