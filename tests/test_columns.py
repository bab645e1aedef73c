"""Hand-computed column, filter and null semantics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from zonalpanel.functions import nulls
from zonalpanel.functions.stats import slope_p_value
from zonalpanel.operators import columns as C
from zonalpanel.operators import filters as L
from zonalpanel.operators import monthly as M
from zonalpanel.operators import pixels as X
from zonalpanel.operators import reshape as R


def values(df, col):
    return [r[col] for r in df.collect()]


def test_nan_is_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    row = nulls.nan_to_null(df).agg(F.avg("v").alias("m"), F.count_if(F.col("v").isNull()).alias("n")).first()
    assert (row.m, row.n) == (1.0, 2)


def test_coerce_numeric(spark):
    texts = ["5", " 5 ", "1,000", "1d", "-.5e1", "", None, "abc", "12."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    assert values(C.coerce_numeric(df, ["v"]).orderBy("i"), "v") == [5, 5, None, None, -5, None, None, None, 12]
    assert values(C.coerce_numeric(df, ["v"], fill=0).orderBy("i"), "v") == [5, 5, 0, 0, -5, 0, 0, 0, 12]


def test_normalize_date(spark):
    texts = ["2024/01/05", "20240105", "2024_01_05", "2024-1-5", "2024/02/30", "2024-01/05", "5 Jan", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    out = values(C.normalize_dates(df, "d").orderBy("i"), "d")
    assert out == ["2024/01/05"] * 4 + [None] * 4


def test_calendar_and_continuous_week(spark):
    days = [dt.date(2021, 1, 1), dt.date(2018, 12, 31), dt.date(2020, 12, 31), dt.date(2021, 1, 4)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
    out = C.continuous_week(C.calendar_parts(df, "d")).orderBy("i").collect()
    assert [(r.year, r.week) for r in out] == [(2021, 53), (2018, 1), (2020, 53), (2021, 1)]
    assert [r.continuous_week for r in out][2:] == [157, 157]
    assert out[0].doy == "001"


def test_regions(spark):
    df = spark.createDataFrame([("Bengkulu",), ("Riau",), ("Atlantis",), (None,)], "NAME_1 string")
    assert values(C.map_region(df), "Region") == ["Sulawesi", "Java", "Unknown", "Unknown"]


def test_rates(spark):
    df = spark.createDataFrame([(3, 0), (3, 1500), (3, None), (5, 2)], "infections int, population int")
    rated = C.incidence_rate(df)
    assert values(rated, "incidence_rate") == [None, 2.0, None, 2500.0]
    assert values(C.cap_incidence(rated), "incidence_rate") == [None, 2.0, None, 1100.0]
    kept, high = L.exclude_high_incidence(rated)
    assert (kept.count(), high.count()) == (1, 1)


def test_month_chunks(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 15), dt.date(2020, 3, 10))], "begin date, end date")
    got = [(r.chunk_begin.isoformat(), r.chunk_end.isoformat()) for r in C.month_chunks(df).orderBy("chunk_begin").collect()]
    assert got == [("2020-01-15", "2020-01-31"), ("2020-02-01", "2020-02-29"), ("2020-03-01", "2020-03-10")]


def test_outliers(spark):
    df = spark.createDataFrame(
        [(1, None, 23.0, 120.5, 23.5), (2, 120.0, 23.0, 0.0, 0.0), (3, 121.0, 23.0, 0.0, 0.0), (4, 119.0, 23.0, 120.1, 22.0)],
        "i int, lon double, lat double, x double, y double",
    )
    valid, outliers = L.split_outliers(df)
    assert sorted(values(valid, "i")) == [2, 3]
    assert sorted(values(outliers, "i")) == [1, 4]
    assert L.split_outliers(L.correct_outliers(df))[1].count() == 0


def test_pixel_masks(spark):
    df = spark.createDataFrame([(q, 5000.0) for q in (0, 1, 2, 3)], "SummaryQA int, NDVI double")
    assert values(X.mask_qa_bit(df, ["NDVI"]), "NDVI") == [0.5, 0.5, None, None]
    lst = spark.createDataFrame([(q, 0, 15000.0, 15000.0) for q in (0, 64, 128, 192)],
                                "QC_Day int, QC_Night int, LST_Day_1km double, LST_Night_1km double")
    warm = X.lst_celsius(X.mask_lst_qc(lst))
    assert [None if v is None else round(v, 2) for v in values(warm, "LST_Mean")] == [26.85, 26.85, 26.85, None]


def test_p_values(spark):
    def p(n, t):
        v = n - 2
        r2 = t * t / (t * t + v)
        return spark.range(1).select(slope_p_value(F.lit(r2), F.lit(n)).alias("p")).first().p

    assert p(14, 2.179) == pytest.approx(0.0499832, abs=1e-6)
    assert p(5, 2.5) == pytest.approx(0.0877066, abs=1e-6)
    assert p(3, 1.0) == pytest.approx(0.5, abs=1e-12)
    row = spark.range(1).select(
        slope_p_value(F.lit(1.0), F.lit(9)).alias("exact"),
        slope_p_value(F.lit(1.0), F.lit(2)).alias("two"),
        slope_p_value(F.lit(0.0), F.lit(2)).alias("flat"),
        slope_p_value(F.lit(0.5), F.lit(1)).alias("one"),
    ).first()
    assert (row.exact, row.two, row.flat, row.one) == (0.0, 0.0, 1.0, None)


def test_wide_to_long(spark):
    df = spark.createDataFrame([(7, 1.0, 2.0, None, 4.0, 9.9)],
                               "zone_id int, `20200101_a` double, `20200101_b` double, `2020_02_29_a` double, `2020_02_29_b` double, area double")
    rows = R.wide_zonal_to_long(df, ["a", "b"]).orderBy("Date").collect()
    assert [tuple(r) for r in rows] == [("2020/01/01", "001", 1.0, 2.0, 7), ("2020/02/29", "060", None, 4.0, 7)]


def test_month_columns_are_required(spark):
    with pytest.raises(ValueError):
        M.monthly_totals(spark.createDataFrame([(2010, 1, "3")], "year int, row_no int, Infection_1 string"))


def test_series_positions_are_dense(spark):
    df = spark.createDataFrame([(y, m, 1.0) for y in (2010, 2012) for m in range(1, 13)], "year int, month int, total double")
    series = M.multi_year_monthly_series(df)
    rows = series.collect()
    assert [r.position for r in rows] == list(range(1, 25))
    assert rows[12].label == "January 2012"
    bounds = {r.year: (r.first_position, r.last_position) for r in M.year_boundaries(series).collect()}
    assert bounds == {2010: (1, 12), 2012: (13, 24)}


def test_weeks_from_first_case(spark):
    df = spark.createDataFrame(
        [(2023, 10, None), (2023, 12, 2), (2023, 15, None), (2023, 40, 1), (2023, 41, 5), (2022, 9, None)],
        "year int, week int, cases int",
    )
    got = sorted((r.year, r.week) for r in L.weeks_from_first_case(df).collect())
    assert got == [(2023, 12), (2023, 15), (2023, 40)]


def test_humidity_units(spark):
    df = spark.createDataFrame([(283.15, 293.15)], "dewpoint_temperature_2m double, temperature_2m double")
    rh = X.relative_humidity(df, unit="K").first().Relative_Humidity
    assert rh == pytest.approx(100 * math.exp(17.625 * 10 / 253.04) / math.exp(17.625 * 20 / 263.04))
