"""Ranks, quantiles, bins and classes against pandas and numpy, with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonalpanel.operators import classify as B
from zonalpanel.operators import distribution as D
from zonalpanel.operators import ordered as O
from zonalpanel.operators import quality as Q


@pytest.fixture(scope="module")
def hot():
    """A third of the rows share one value and one group; some values are missing."""
    rng = np.random.default_rng(5)
    n = 6000
    v = np.round(rng.gamma(2.0, 10.0, n), 1)
    v[: n // 3] = 7.5
    g = rng.integers(0, 9, n)
    g[n // 4 : n // 4 + n // 3] = 0
    pdf = pd.DataFrame({"id": range(n), "g": g, "v": v})
    pdf.loc[pdf.id % 17 == 0, "v"] = np.nan
    pdf.loc[pdf.g == 8, "v"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def hot_df(spark, hot):
    rows = [(int(i), int(g), None if np.isnan(v) else float(v)) for i, g, v in hot.itertuples(index=False)]
    return spark.createDataFrame(rows, "id int, g int, v double").repartition(8)


@pytest.mark.parametrize("ascending", [True, False])
def test_average_rank(hot, hot_df, ascending):
    rank = O.rank_average_asc if ascending else O.rank_average_desc
    got = rank(hot_df, "v").toPandas().set_index("id")["rank"].sort_index()
    want = hot.set_index("id")["v"].rank(ascending=ascending)
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())


def test_small_ranks(spark):
    df = spark.createDataFrame([(5,), (3,), (3,), (None,), (1,)], "v int")
    got = sorted(((r.v, r["rank"]) for r in O.rank_average_desc(df, "v").collect()), key=repr)
    assert got == sorted([(5, 1.0), (3, 2.5), (3, 2.5), (None, None), (1, 4.0)], key=repr)


def test_grouped_quantiles(hot, hot_df):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.g: r.quantiles for r in O.exact_quantiles(hot_df, "v", probs, ["g"]).collect()}
    for g, part in hot.groupby("g"):
        if part.v.notna().any():
            assert got[g] == pytest.approx(np.quantile(part.v.dropna(), probs), rel=1e-12)
        else:
            assert got[g] == [None] * len(probs)


def test_describe(hot, hot_df):
    row = D.describe(hot_df, "v").first()
    want = hot.v.describe()
    got = [row[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
    assert got == pytest.approx(list(want), rel=1e-9)


def test_histogram(hot, hot_df):
    counts, edges = np.histogram(hot.v.dropna(), bins=10)
    rows = D.histogram(hot_df, "v", 10).orderBy("bin").collect()
    assert [r.n for r in rows] == list(counts)
    assert [r.bin_left for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value(spark):
    rows = D.histogram(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v", 10).orderBy("bin").collect()
    assert [r.n for r in rows] == list(np.histogram([4.0, 4.0], bins=10)[0])


@pytest.mark.parametrize("q", [2, 4, 5, 8])
def test_quantile_bins(hot, hot_df, q):
    got = B.quantile_bins(hot_df, "v", q).toPandas().set_index("id")["bin"].sort_index()
    want = pd.qcut(hot.set_index("id")["v"], q, labels=False, duplicates="drop")
    np.testing.assert_array_equal(got.astype(float), want.astype(float))


def test_tercile_bins_small(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert [r.bin for r in B.quantile_bins(df, "v", 3).orderBy("v").collect()] == [0, 0, 1, 2, 2]


def test_repeated_edges_are_an_error_on_request(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "v double")
    with pytest.raises(Exception, match="edges repeat"):
        B.quantile_bins(df, "v", 4, drop_repeated=False).collect()


def test_death_fallback(spark):
    deaths = [0] * 6 + [1, 2, 9, 50]
    df = spark.createDataFrame([(i, d, i * 3) for i, d in enumerate(deaths)], "zone_id int, d int, i int")
    rows = B.bivariate_class_4x4(df, "d", "i").orderBy("zone_id").collect()
    assert [r.death_code for r in rows] == [0] * 6 + [1, 1, 1, 2]
    want = pd.qcut(pd.Series([i * 3 for i in range(10)]), 4, labels=False)
    assert [r.infection_code for r in rows] == list(want)
    assert rows[0].color == "#e8e8e8"


def test_all_equal_is_class_zero(spark):
    df = spark.createDataFrame([(i, 3, 4) for i in range(5)], "zone_id int, d int, i int")
    assert {r.bivariate_class for r in B.bivariate_class_4x4(df, "d", "i").collect()} == {"00"}


def test_every_nth_counts_copies(spark):
    values = [1] * 7 + [2] * 2 + [3] * 12 + [4]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    got = sorted(r.v for r in O.every_nth(df, ["v"], 5).collect())
    assert got == values[::5]


def test_numbers_take_one_shuffle(spark, monkeypatch):
    """A third of the rows are copies of one; they fill ranges like other rows, and no range has them all."""
    plans, tables, real = [], [], O.written

    def kept(df, label):
        plans.append(df)
        tables.append(real(df, label))
        return tables[-1]

    monkeypatch.setattr(O, "written", kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    values = [None] * 3 + list(range(600)) + [250] * 300
    df = spark.createDataFrame([(v, "x") for v in values], "v int, w string").repartition(6)
    got = O.numbered(df, ["v"])
    rows = sorted((r._number, r.v) for r in got.collect())
    assert [n for n, _ in rows] == list(range(len(values)))
    assert [v for _, v in rows] == sorted(values, key=lambda v: -1 if v is None else v)
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in tables[0].groupBy(F.shiftright("_id", 33)).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 300
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert O.numbered(df.limit(0), ["v"]).count() == 0


def test_rolling_mean(spark):
    s = pd.Series([1.0, None, 3.0, 10.0, 5.0, 6.0, 7.0, 8.0, 9.0, None])
    days = pd.date_range("2019-12-28", periods=len(s))
    df = spark.createDataFrame([(d.date(), None if pd.isna(v) else float(v)) for d, v in zip(days, s)], "date date, v double")
    got = [r.v_smooth for r in Q.rolling_mean(df, ["v"]).orderBy("date").collect()]
    assert got == pytest.approx(list(s.rolling(7, min_periods=1).mean()))


def test_ranges_spread_a_hot_group(spark):
    """A group with a third of the rows is cut into several ranges, as are the others together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        big = spark.range(0, 300000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
            (F.col("id") * 7919 % 299993).alias("v"),
        )
        counts = O._value_counts(big, F.col("v"), ["g"])
        per_range = counts.groupBy("_b").count().toPandas()["count"]
        hot_ranges = counts.where("g = 0").select("_b").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(per_range) == 8 and per_range.max() < 2 * 300000 / 8
    assert hot_ranges >= 3


def test_rank_comparison_without_a_rank_is_red(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "zone_id int, case_rank double")
    b = spark.createDataFrame([(1, 2.0), (2, 2.0), (4, 1.0)], "zone_id int, egg_rank double")
    got = {r.zone_id: r.color for r in B.rank_comparison(a, b).collect()}
    assert got == {1: "blue", 2: "red", 3: "red", 4: "red"}
