"""Ranks, quantile bins and bivariate classes over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import COLOURS_3X3, COLOURS_4X4
from ..operators import classify as B
from ..operators import monthly as M
from ..operators import ordered as O
from ..operators.counts import count_cases
from .inputs import Inputs, r, rd
from .registry import query

_RANK = """
SELECT l_orderkey, l_linenumber, l_partkey, q AS value,
       CASE WHEN q IS NOT NULL THEN rank() OVER (ORDER BY q {0} NULLS LAST) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE END AS rank
FROM (SELECT *, CASE WHEN l_quantity < 49 THEN l_quantity END AS q FROM lineitem)"""


def _quantities(t: Inputs):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_quantity") < 49, F.col("l_quantity")).alias("value"),
    )


@query("", _RANK.format("DESC"))
def rank_average_desc(t: Inputs):
    return O.rank_average_desc(_quantities(t), "value")


@query("", _RANK.format("ASC"))
def rank_average_asc(t: Inputs):
    return O.rank_average_asc(_quantities(t), "value")


@query("local_counts", """
WITH change AS (SELECT zone_id, sum(CASE WHEN year = 2000 THEN infections ELSE 0 END) - sum(CASE WHEN year = 1996 THEN infections ELSE 0 END) AS change
                FROM local_counts WHERE year IN (1996, 2000) GROUP BY zone_id),
     eggs AS (SELECT s_nationkey AS zone_id, sum(l_quantity) AS eggs FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
     a AS (SELECT zone_id, rank() OVER (ORDER BY change DESC) + (count(*) OVER (PARTITION BY change) - 1) / 2.0::DOUBLE AS case_rank FROM change),
     b AS (SELECT zone_id, rank() OVER (ORDER BY eggs DESC) + (count(*) OVER (PARTITION BY eggs) - 1) / 2.0::DOUBLE AS egg_rank FROM eggs)
SELECT a.zone_id, case_rank, egg_rank, CASE WHEN case_rank < egg_rank THEN 'blue' ELSE 'red' END AS color
FROM a LEFT JOIN b ON a.zone_id = b.zone_id""")
def rank_comparison(t: Inputs):
    change = B.case_change(count_cases(t.cases), 1996, 2000)
    eggs = t.traps.groupBy("zone_id").agg(F.sum("avg_eggs").alias("eggs"))
    a = O.rank_average_desc(change, "change", "case_rank").select("zone_id", "case_rank")
    b = O.rank_average_desc(eggs, "eggs", "egg_rank").select("zone_id", "egg_rank")
    return B.rank_comparison(a, b)


def _bins_sql(table: str, key: str, col: str, q: int) -> str:
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    return f"""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont({col}, [{probs}]))) AS edges FROM {table})
SELECT {key}, CAST(greatest(len(list_filter(edges, lambda v: v < {col})) - 1, 0) AS INTEGER) AS bin FROM {table}, e"""


@query("", _bins_sql("customer", "c_custkey", "c_acctbal", 5))
def quantile_bins(t: Inputs):
    return B.quantile_bins(t.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5).drop("c_acctbal")


@query("customer_counts", _bins_sql("customer_counts", "zone_id", "CAST(infections AS DOUBLE)", 8))
def quantile_bins_repeated(t: Inputs):
    return B.quantile_bins(t.customer_counts.select("zone_id", "infections"), "infections", 8).drop("infections")


def _pick(quantiles: str, bins: str) -> str:
    places = {1: (1, 7), 2: (1, 4, 7), 3: (1, 3, 5, 7), 4: (1, 2, 4, 6, 7)}
    whens = " ".join(
        f"WHEN {n} THEN [{', '.join(f'{quantiles}[{i}]' for i in at)}]" for n, at in places.items()
    )
    return f"CASE {bins} {whens} END"


_PROBS = f"[0, 0.25, {1 / 3!r}, 0.5, {2 / 3!r}, 0.75, 1]"
_COLOUR_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in COLOURS_4X4.items())


def _codes_cte(table: str) -> str:
    code = "greatest(len(list_filter({0}e2, lambda v: v < {0})) - 1, 0)"
    return f"""
WITH base AS (SELECT zone_id, CAST(deaths AS DOUBLE) AS d, CAST(infections AS DOUBLE) AS i FROM {table}),
     q AS (SELECT quantile_cont(d, {_PROBS}) AS dq, quantile_cont(i, {_PROBS}) AS iq,
                  count(DISTINCT d) AS dk, count(DISTINCT i) AS ik FROM base),
     e1 AS (SELECT *, {_pick('dq', 'least(dk, 4)')} AS de1, {_pick('iq', 'least(ik, 4)')} AS ie1 FROM q),
     e2 AS (SELECT *, {_pick('dq', 'len(list_distinct(de1)) - 1')} AS de2, {_pick('iq', 'len(list_distinct(ie1)) - 1')} AS ie2 FROM e1),
     codes AS (SELECT zone_id,
         CASE WHEN dk = 1 THEN 0
              WHEN len(list_distinct(de2)) = len(de2) THEN {code.format('d')}
              WHEN d = 0 THEN 0 WHEN d BETWEEN 1 AND 10 THEN 1 ELSE 2 END AS dc,
         CASE WHEN ik = 1 THEN 0 WHEN len(list_distinct(ie2)) = len(ie2) THEN {code.format('i')} END AS ic
         FROM base, e2),
     colours AS (SELECT * FROM (VALUES {_COLOUR_ROWS}) v(k, c))
SELECT zone_id, CAST(dc AS INTEGER) AS death_code, CAST(ic AS INTEGER) AS infection_code,
       CAST(dc AS VARCHAR) || CAST(ic AS VARCHAR) AS bivariate_class, c AS color
FROM codes LEFT JOIN colours ON k = CAST(dc AS VARCHAR) || CAST(ic AS VARCHAR)"""


@query("customer_counts", _codes_cte("customer_counts"))
def bivariate_class_4x4(t: Inputs):
    return B.bivariate_class_4x4(t.customer_counts, "deaths", "infections").drop("deaths", "infections")


_SPREAD = "(SELECT zone_id, deaths * 1000003 % 997 AS deaths, infections * 7 + zone_id % 13 AS infections FROM customer_counts)"


@query("customer_counts", _codes_cte(_SPREAD))
def bivariate_class_4x4_spread(t: Inputs):
    spread = t.customer_counts.select(
        "zone_id",
        (F.col("deaths") * 1000003 % 997).alias("deaths"),
        (F.col("infections") * 7 + F.col("zone_id") % 13).alias("infections"),
    )
    return B.bivariate_class_4x4(spread, "deaths", "infections").drop("deaths", "infections")


def _tercile(table: str, col: str) -> str:
    return f"""SELECT zone_id, {col}, CAST(rk > 1 + (n - 1) * 1 / 3.0::DOUBLE AS INTEGER) + CAST(rk > 1 + (n - 1) * 2 / 3.0::DOUBLE AS INTEGER) AS code
    FROM (SELECT zone_id, {col}, row_number() OVER (ORDER BY {col}, zone_id) AS rk, count(*) OVER () AS n FROM {table})"""


_COLOUR_3 = ", ".join(f"('{i}{j}', '{c}')" for i, row in enumerate(COLOURS_3X3) for j, c in enumerate(row))


@query("", f"""
WITH eggs AS (SELECT l_partkey AS zone_id, sum(l_quantity) AS avg_eggs FROM lineitem GROUP BY 1),
     rates AS (SELECT p_partkey AS zone_id, p_retailprice AS incidence_rate FROM part),
     a AS ({_tercile('eggs', 'avg_eggs')}), b AS ({_tercile('rates', 'incidence_rate')}),
     colours AS (SELECT * FROM (VALUES {_COLOUR_3}) v(k, c))
SELECT a.zone_id, a.avg_eggs, b.incidence_rate, a.code AS egg_code, b.code AS rate_code, c AS color
FROM a JOIN b ON a.zone_id = b.zone_id JOIN colours ON k = CAST(b.code AS VARCHAR) || CAST(a.code AS VARCHAR)""")
def bivariate_class_3x3(t: Inputs):
    eggs = t.table("lineitem").groupBy(F.col("l_partkey").alias("zone_id")).agg(F.sum("l_quantity").alias("avg_eggs"))
    rates = t.table("part").select(F.col("p_partkey").alias("zone_id"), F.col("p_retailprice").alias("incidence_rate"))
    return B.bivariate_class_3x3(eggs, rates)


@query("", """
SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year, CAST((year(l_shipdate) - 1995) * 52 + 1 AS INTEGER) AS start_week FROM lineitem""")
def year_start_weeks(t: Inputs):
    years = t.table("lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return M.year_start_weeks(years, base=1995)


@query("panel", f"""
SELECT zone_id, {rd('q[1]')} AS q10, {rd('q[2]')} AS q50, {rd('q[3]')} AS q90
FROM (SELECT zone_id, quantile_cont(price_MEAN, [0.1, 0.5, 0.9]) AS q FROM panel GROUP BY zone_id)""")
def exact_quantiles_by_zone(t: Inputs):
    q = O.exact_quantiles(t.panel, "price_MEAN", [0.1, 0.5, 0.9], ["zone_id"])
    return q.select("zone_id", *[r(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])
