"""Joins, imputation, yearly statistics, sources and sinks."""

import datetime as dt
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonalpanel import session
from zonalpanel.operators import counts as K
from zonalpanel.operators import joins as J
from zonalpanel.operators import reshape as R
from zonalpanel.operators import spatial as S
from zonalpanel.operators import yearly as Y
from zonalpanel.sources import moments as MO
from zonalpanel.sources import pixels as PX
from zonalpanel.sources import sinks as W
from zonalpanel.sources import tables as T
from zonalpanel.sources import zones as Z

PANEL = "zone_id int, date date, v double"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_donor_fill_is_idempotent(spark):
    rows = [(1, day(i), float(i)) for i in range(5)] + [(1, day(2), -9.0), (2, day(0), 7.0), (3, day(9), 1.0)]
    panel = spark.createDataFrame(rows, PANEL)
    donors = spark.createDataFrame([(2, 1), (4, 1)], "missing_id int, donor_id int")
    once = J.impute_from_donor(panel, donors)
    added = sorted((r.zone_id, r.date, r.v) for r in once.exceptAll(panel).collect())
    want = [(2, day(i), -9.0 if i == 2 else float(i)) for i in range(1, 5)]
    want += [(4, day(i), -9.0 if i == 2 else float(i)) for i in range(5)]
    assert added == sorted(want)
    assert J.impute_from_donor(once, donors).count() == once.count()


def test_outer_merge_keeps_left_values(spark):
    a = spark.createDataFrame([(1, day(0), 1.0, 5), (1, day(1), None, 6), (None, day(3), 2.0, 7)], "zone_id int, date date, v double, only_a int")
    b = spark.createDataFrame([(1, day(0), 9.0, 1), (1, day(1), 8.0, 2), (2, day(2), 7.0, 3), (None, day(3), 4.0, 4)], "zone_id int, date date, v double, only_b int")
    merged = J.merge_panels_outer(a, b, keys=("date", "zone_id"))
    got = sorted(((r.zone_id, r.date, r.v, r.only_a, r.only_b) for r in merged.collect()), key=str)
    want = [(1, day(0), 1.0, 5, 1), (1, day(1), 8.0, 6, 2), (2, day(2), 7.0, None, 3), (None, day(3), 2.0, 7, 4)]
    assert got == sorted(want, key=str)


def test_missing_names_match_each_other(spark):
    zones = spark.createDataFrame([(1, "A", None), (2, "B", "b")], "zone_id int, NAME_1 string, NAME_2 string")
    sheet = spark.createDataFrame([("A", None, 5), ("C", "c", 6)], "Province string, City string, n int")
    joined = J.zones_left_join_cases(zones, sheet, ("NAME_1", "NAME_2"), ("Province", "City"))
    assert {r.zone_id: r.n for r in joined.collect()} == {1: 5, 2: None}


def test_sums_and_counts_of_nothing(spark):
    df = spark.createDataFrame([(2020, 1, None), (2020, 1, None), (2020, 2, 3.0), (None, 2, 4.0)], "year int, week int, v double")
    assert {(r.week, r.v) for r in K.weekly_sum(df, "v").collect()} == {(1, 0.0), (2, 3.0)}
    assert {(r.week, r.infections) for r in K.count_cases(df, ("year", "week")).collect()} == {(1, 2), (2, 1)}


def test_yearly_statistics_against_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"zone_id": rng.integers(0, 6, 3000), "year": rng.integers(2000, 2008, 3000), "v": rng.normal(50, 5, 3000)})
    pdf.loc[: len(pdf) // 3, "zone_id"] = 1
    pdf.loc[pdf.index % 11 == 0, "v"] = np.nan
    zones = pd.DataFrame({"zone_id": range(6), "Region": ["a", "a", "b", "b", None, "c"]})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    zone_df = spark.createDataFrame([tuple(x) for x in zones.itertuples(index=False)], "zone_id int, Region string")

    merged = zones.merge(pdf, on="zone_id").dropna(subset=["Region"])
    got = Y.region_year_std(df, zone_df, ["v"]).toPandas().set_index(["year", "Region"])["v_std"].sort_index()
    pd.testing.assert_series_equal(got, merged.groupby(["year", "Region"])["v"].std(), check_names=False, check_index_type=False)
    got = Y.region_mean(df, zone_df, ["v"]).toPandas().set_index("Region")["v_mean"].sort_index()
    pd.testing.assert_series_equal(got, merged.groupby("Region")["v"].mean(), check_names=False)

    yearly = Y.yearly_zone_stats(df, ["v"])
    stats = Y.stability_stats(yearly, "v").toPandas().set_index("zone_id").sort_index()
    y = pdf.groupby(["year", "zone_id"])["v"].agg(["mean", "std"]).reset_index()
    np.testing.assert_allclose(stats["std_over_years"], y.groupby("zone_id")["mean"].std())
    np.testing.assert_allclose(stats["std_std_over_years"], y.groupby("zone_id")["std"].std())
    trend = Y.stability_trend(yearly, "v").toPandas().set_index("zone_id").sort_index()
    slope = y.groupby("zone_id").apply(lambda g: np.polyfit(g["year"], g["std"], 1)[0], include_groups=False)
    np.testing.assert_allclose(trend["stability_trend"], slope)
    several = Y.stability_trend(yearly.withColumn("w_std", F.col("v_std") * 2), ["v", "w"]).toPandas()
    np.testing.assert_allclose(several["w_stability_trend"], several["v_stability_trend"] * 2)
    assert "v_mean_CV" in Y.stability_stats(yearly, ["v"]).columns


def test_trend_edge_cases(spark):
    rows = [(1, 2000 + i, 3.0) for i in range(4)] + [(2, 2000, 1.0), (2, 2001, 2.0), (3, 2000, 1.0)]
    rows += [(4, 2000, 1.0), (4, 2001, None), (4, 2002, 5.0), (4, 2003, 2.0)]
    yearly = spark.createDataFrame(rows, "zone_id int, year int, v_std double")
    got = {r.zone_id: (r.stability_trend, r.p_value) for r in Y.stability_trend(yearly, "v", strict=False).collect()}
    assert got[1] == (0.0, 1.0)
    assert got[2] == (1.0, 0.0)
    assert got[3] == (None, None)
    assert got[4][0] is not None
    strict = {r.zone_id: r.stability_trend for r in Y.stability_trend(yearly, "v").collect()}
    assert strict[4] is None and strict[2] == 1.0


def test_region_std_of_one_row(spark):
    df = spark.createDataFrame([(1, 2020, 5.0)], "zone_id int, year int, v double")
    zones = spark.createDataFrame([(1, "a")], "zone_id int, Region string")
    assert Y.region_year_std(df, zones, ["v"]).first().v_std is None


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3, 4)], "b int, c int")
    assert sorted(((r.a, r.b, r.c) for r in R.union_panels(a, b, a).collect()), key=str) == sorted(
        [(1, 2, None), (None, 3, 4), (1, 2, None)], key=str
    )


# ---------------------------------------------------------------- sources and sinks


def test_table_dir(spark, tmp_path):
    (tmp_path / "ERA_2010.csv").write_text("zone_id,v\n1,NaN\n2,3.5\n")
    (tmp_path / "prec_2011.csv").write_text("zone_id,v\n3,\n")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "Era+B.csv").write_text("w,v,zone_id\n9,4.5,4\n")
    (tmp_path / "part-1999.csv").write_text("zone_id\n5\n")
    rows = T.read_table_dir(spark, str(tmp_path), "zone_id int, v double").collect()
    assert sorted(((r.source_name, r.zone_id, r.v) for r in rows), key=str) == sorted(
        [("era_2010", 1, None), ("era_2010", 2, 3.5), ("prec_2011", 3, None), ("era+b", 4, 4.5), ("part-1999", 5, None)],
        key=str,
    )


def test_case_and_trap_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X,Y,StartTime,District,AvgEggs\n1,2,2020-01-02 03:04:05,d,7\n")
    (tmp_path / "b.csv").write_text("extra,AvgEggs,StartTime,Y,X,District\n0,NaN,x,4,3,e\n")
    got = sorted((r.x, r.y, str(r.start_time), r.district, r.avg_eggs) for r in T.read_traps(spark, str(tmp_path)).collect())
    assert got == [(1.0, 2.0, "2020-01-02 03:04:05", "d", 7.0), (3.0, 4.0, "None", "e", None)]
    with pytest.raises(ValueError):
        T.read_cases(spark, str(tmp_path))


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    for i, text in enumerate(["a,b\n1,2\n", "a,b\n3,4\n", "b,a\n5,6\n", ""]):
        (tmp_path / f"{i}.csv").write_text(text)
    (tmp_path / "4.csv").write_bytes("a,b\n1,中\n".encode("big5"))
    files = T._files(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "ObjectHash" not in plan
    groups = [(code, [Path(p).name for p in paths]) for code, paths in T._same_headers(spark, str(tmp_path))]
    assert groups == [("utf-8", ["0.csv", "1.csv"]), ("utf-8", ["2.csv"]), ("big5", ["4.csv"])]


def test_scratch_is_released(spark):
    table = session.written(spark.range(3), "some")
    folder = Path(urlparse(table.inputFiles()[0]).path).parent
    assert table.count() == 3 and folder.is_dir()
    assert session.release(spark) >= 1
    assert not folder.exists() and session.release(spark) == 0


def test_population_encodings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    body = "CODEBASE,TOWN,P_CNT,M_CNT,F_CNT\n中西區-1,中西區,10,4,6\n"
    (tmp_path / "a" / "104年12月人口.csv").write_bytes(body.encode("utf-8"))
    (tmp_path / "統計112年_x.csv").write_bytes(body.replace("10,4,6", "1x,,2").encode("big5"))
    rows = T.read_population_by_year(spark, str(tmp_path)).collect()
    got = {r.year: (r.zone_id, r.p_cnt, r.m_cnt, r.f_cnt) for r in rows}
    assert got == {2015: ("中西區-1", "10", "4", "6"), 2023: ("中西區-1", "1x", None, "2")}


def test_too_many_sheets(spark):
    with pytest.raises(ValueError):
        T.read_yearly_sheets(spark, {2010 + i: "x" for i in range(15)})


def test_geojson_round_trip(spark, tmp_path):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    other = [(10, 0), (12, 0), (12, 2), (10, 0)]
    rows = []
    for part, ring, pts in ((0, 0, outer), (0, 1, hole), (1, 0, other)):
        rows += [(5, "n", part, ring, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    vertices = spark.createDataFrame(rows, "zone_id int, name string, part int, ring int, seq int, x double, y double")
    vertices.write.parquet(str(tmp_path / "v"))
    zones = Z.read_zones(spark, str(tmp_path / "v"), "zone_id int, name string", form="vertices")
    Z.write_zone_layer(zones, str(tmp_path / "g"))
    text = spark.read.text(str(tmp_path / "g")).first().value
    assert text.startswith('{"type":"Feature","properties":{"zone_id":5,"name":"n"},"geometry":{"type":"MultiPolygon"')
    back = Z.read_zones(spark, str(tmp_path / "g"), "zone_id int, name string").first()
    assert back.name == "n"
    assert back.rings == zones.first().rings
    assert len(back.rings) == 3


def test_pixel_scan_prunes_folders(spark, tmp_path):
    rows = [(d, day(i), float(i), 0.0, float(i), 1) for d in ("A", "B") for i in range(10)]
    df = spark.createDataFrame(rows, "dataset string, image_date date, x double, y double, NDVI double, qa int")
    PX.write_pixels(df, str(tmp_path / "p"))
    got = PX.scan_pixels(spark, str(tmp_path / "p"), "A", "2020-01-03", "2020-01-05", ["NDVI"])
    assert sorted(r.NDVI for r in got.collect()) == [2.0, 3.0, 4.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "ReadSchema: struct<x:double,y:double,NDVI:double>" in plan
    assert PX.first_image(df).count() == 2


def test_write_panel_formats(spark, tmp_path):
    df = spark.createDataFrame([(2019, 1.5), (2020, None)], "year int, v double")
    W.write_panel(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["year", "v"]
    W.write_panel(df, str(tmp_path / "p"), fmt="parquet", partition_by=["year"])
    assert (tmp_path / "p" / "year=2019").is_dir()
    with pytest.raises(ValueError):
        W.write_panel(df, str(tmp_path / "x"), fmt="orc")


def test_donor_search_runs_once(spark, tmp_path):
    """The plan of the filled panel reads the written map and nothing of what the map was made from."""
    spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "zone_id int, cx double, cy double").write.parquet(f"{tmp_path}/centroids")
    panel = spark.createDataFrame([(i, day(0), 1.0 * i) for i in (0, 1, 4, 5)], PANEL)
    donors = S.nearest_donor_zone(spark.read.parquet(f"{tmp_path}/centroids"), [2, 3])
    filled = J.impute_from_donor(panel, donors)
    plan = filled._jdf.queryExecution().optimizedPlan().toString() + str(filled.inputFiles())
    assert "centroids" not in plan and all("donor-map" in f for f in filled.inputFiles())
    assert sorted((r.zone_id, r.v) for r in filled.collect() if r.zone_id in (2, 3)) == [(2, 1.0), (3, 4.0)]


def test_moments_by_period(spark, tmp_path):
    """Added one by one, rerun with late rows, they equal the statistics of the whole panel; a new period reads no old one."""
    rng = np.random.default_rng(3)
    rows = [(int(z), day(int(d)), None if k % 9 == 0 else 1e9 + float(v)) for k, (z, d, v) in enumerate(zip(rng.integers(0, 4, 600), rng.integers(0, 900, 600), rng.normal(0, 1, 600)))]
    rows += [(9, day(3), 5.0), (10, day(3), None), (None, day(3), 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, PANEL)
    root, cut = f"{tmp_path}/moments", [day(0), day(250), day(500), day(900)]
    parts = [df.where((F.col("date") >= a) & (F.col("date") < b)) for a, b in zip(cut, cut[1:])]
    MO.write_period(parts[1].limit(20), root, "2021", ["v"])
    MO.write_period(parts[0], root, "2020", ["v"])
    MO.write_period(parts[1], root, "2021", ["v"])
    before = {r.zone_id for r in MO.yearly_zone_stats(spark, root, ["v"]).collect()}
    files = sorted(Path(root).glob("period=202*/*.parquet"))
    MO.write_period(parts[2], root, "2022", ["v"])
    assert set(files) < set(Path(root).glob("period=202*/*.parquet")) and 9 in before
    got = {(r.year, r.zone_id): (r.v_mean, r.v_std) for r in MO.yearly_zone_stats(spark, root, ["v"]).collect()}
    want = {(r.year, r.zone_id): (r.v_mean, r.v_std) for r in Y.yearly_zone_stats(df, ["v"]).collect()}
    assert got.keys() == want.keys() and got[2020, 9] == (5.0, None) and got[2020, 10] == (None, None)
    for k, (mean, std) in want.items():
        assert got[k][0] == (None if mean is None else pytest.approx(mean, rel=1e-14))
        assert got[k][1] == (None if std is None else pytest.approx(std, rel=1e-6))
    with pytest.raises(ValueError):
        MO.write_period(parts[0], root, "a/b", ["v"])
