"""The library's inputs, derived from the star-schema tables, in Spark and in SQL.

Orders become a zone-day climate panel and a case line-list, customers become points and
populations, line items become trap visits and pixels, nations become square zones.
``SQL`` holds the same derivations as common table expressions for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import LAND_COVER_CLASSES, province_regions
from ..session import prepare

MONTHS = range(1, 13)

# Prices and bands are divided by a prime: averages of plain cents often end in an exact
# half of the last compared digit, where two engines may round apart.
UNIT = 997
POPULATION_YEARS = tuple(range(1995, 2002))
PROVINCES = [*sorted(province_regions()), "Atlantis"]


def r(value: Column, digits: int = 6) -> Column:
    """Rounded double; adding zero turns -0.0 into 0.0."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def text_date(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("date").cast("string")


def _day(c: str) -> Column:
    return F.to_date(c)


def _lattice(key: str, step: int) -> Column:
    return (F.col(key) * step % 5000) / F.lit(1000.0)


class Inputs:
    """Tables of one directory and what is derived from them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def zone_facts(self) -> DataFrame:
        """Zone attributes: id, name, region."""
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("zone_id"),
                F.col("n_name").alias("zone_name"),
                F.col("r_name").alias("Region"),
            )
        )

    @cached_property
    def zones(self) -> DataFrame:
        """Unit squares on a 5 x 5 board, each with one closed outline."""
        x0 = (F.col("zone_id") % 5).cast("double")
        y0 = F.floor(F.col("zone_id") / 5).cast("double")
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        ring = F.array(
            *[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in corners]
        )
        return self.zone_facts.withColumn("rings", F.array(ring))

    @cached_property
    def placed_orders(self) -> DataFrame:
        """Orders with the zone of their customer."""
        return self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Zone x day statistics with real gaps."""
        cents = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        return (
            self.placed_orders.groupBy(
                F.col("c_nationkey").alias("zone_id"), _day("o_orderdate").alias("date")
            )
            .agg(
                (cents / F.count(F.lit(1)) / UNIT).alias("price_MEAN"),
                (F.min("o_totalprice") / UNIT).alias("price_min_MEAN"),
                (F.max("o_totalprice") / UNIT).alias("price_max_MEAN"),
            )
        )

    @cached_property
    def full_panel(self) -> DataFrame:
        """Every zone on every day of the span; days without orders have NULLs."""
        days = self.table("orders").agg(
            F.struct(
                F.min(_day("o_orderdate")).alias("a"), F.max(_day("o_orderdate")).alias("b")
            )
        ).scalar()
        template = self.zone_facts.select("zone_id", days.alias("d")).select(
            "zone_id", F.explode(F.sequence("d.a", "d.b")).alias("date")
        )
        odd = F.when(F.day("date") % 2 == 1, F.col("price_max_MEAN"))
        return template.join(self.panel, ["zone_id", "date"], "left").withColumn(
            "price_max_MEAN", odd
        )

    @cached_property
    def cases(self) -> DataFrame:
        """Case line-list with onset, imported flag, county, town and zone (some unknown)."""
        return self.placed_orders.select(
            F.col("o_orderkey").alias("case_id"),
            _day("o_orderdate").alias("onset"),
            F.when(F.col("o_orderstatus") == "P", "是").otherwise("否").alias("imported"),
            F.col("c_mktsegment").alias("county"),
            F.col("o_orderpriority").alias("town"),
            F.when(F.col("c_nationkey") != 24, F.col("c_nationkey")).alias("zone_id"),
            F.year("o_orderdate").alias("year"),
        )

    @cached_property
    def local_counts(self) -> DataFrame:
        """Cases per year and zone."""
        from ..operators.counts import count_cases

        return count_cases(self.cases)

    @cached_property
    def population(self) -> DataFrame:
        """Customers per zone for seven years, counts as text, some not numbers."""
        people = F.count(F.lit(1))
        base = self.table("customer").groupBy(F.col("c_nationkey").alias("zone_id")).agg(
            people.alias("p"), F.count_if(F.col("c_custkey") % 2 == 0).alias("m")
        )
        text = (
            F.when(F.col("zone_id") == 3, "n/a")
            .when(F.col("zone_id") == 4, "0")
            .otherwise((F.col("p") + F.col("year") - 1996).cast("string"))
        )
        return base.withColumn(
            "year", F.explode(F.array(*[F.lit(y) for y in POPULATION_YEARS]))
        ).select(
            "year",
            "zone_id",
            text.alias("p_cnt"),
            F.col("m").alias("m_cnt"),
            (F.col("p") - F.col("m")).alias("f_cnt"),
        )

    @cached_property
    def traps(self) -> DataFrame:
        """Trap visits: time, district, zone, eggs."""
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_shipdate").alias("start_time"),
                F.col("l_returnflag").alias("district"),
                F.col("s_nationkey").alias("zone_id"),
                F.col("l_quantity").alias("avg_eggs"),
            )
        )

    @cached_property
    def points(self) -> DataFrame:
        """Points with a value and a year; many lie on zone boundaries."""
        return self.table("customer").select(
            F.col("c_custkey").alias("point_id"),
            _lattice("c_custkey", 7919).alias("x"),
            _lattice("c_custkey", 104729).alias("y"),
            F.col("c_acctbal").alias("value"),
            (F.col("c_custkey") % 5 + 2015).cast("int").alias("year"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        """Pixels of monthly images with two bands and quality words."""
        return self.table("lineitem").select(
            F.when(F.col("l_linenumber") == 1, "A").otherwise("B").alias("dataset"),
            F.trunc(_day("l_shipdate"), "MM").alias("image_date"),
            _lattice("l_partkey", 7919).alias("x"),
            _lattice("l_orderkey", 104729).alias("y"),
            (F.col("l_extendedprice") / UNIT).alias("NDVI"),
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / UNIT).alias("EVI"),
            (F.col("l_partkey") % 256).cast("int").alias("SummaryQA"),
            (F.col("l_partkey") % 256).cast("int").alias("QC_Day"),
            (F.col("l_suppkey") * 7 % 256).cast("int").alias("QC_Night"),
        )

    @cached_property
    def land_pixels(self) -> DataFrame:
        """Land cover pixels: zone, class, area."""
        codes = F.array(*[F.lit(c) for c in LAND_COVER_CLASSES])
        return self.table("part").select(
            (F.col("p_partkey") % 25).alias("zone_id"),
            F.get(codes, F.col("p_size") % 10).alias("class_code"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("area"),
        )

    @cached_property
    def sheets(self) -> DataFrame:
        """Wide monthly sheets as text: one row per year and zone, with its row number."""
        month = F.month("o_orderdate")
        sums = []
        for m in MONTHS:
            sums.append(F.count_if(month == m).alias(f"i{m}"))
            sums.append(F.count_if((month == m) & (F.col("o_orderpriority") == "1-URGENT")).alias(f"d{m}"))
        wide = self.placed_orders.groupBy(
            F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("zone_id")
        ).agg(*sums)

        def as_text(m: int) -> Column:
            junk = (F.col("zone_id") == 7) & F.lit(m == 3)
            return F.when(junk, "n.a.").otherwise(F.col(f"i{m}").cast("string"))

        return wide.select(
            "year",
            (F.col("zone_id") + 1).alias("row_no"),
            F.concat(F.lit("Province "), (F.col("zone_id") % 5).cast("string")).alias("Province"),
            F.concat(F.lit("City "), F.col("zone_id").cast("string")).alias("City"),
            *[as_text(m).alias(f"Infection_{m}") for m in MONTHS],
            *[F.col(f"d{m}").cast("string").alias(f"Death_{m}") for m in MONTHS],
        )

    @cached_property
    def customer_counts(self) -> DataFrame:
        """Orders and urgent orders per customer, none included."""
        orders = self.table("orders").groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"),
        )
        return (
            self.table("customer")
            .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                F.col("c_custkey").alias("zone_id"),
                F.coalesce("u", F.lit(0)).alias("deaths"),
                F.coalesce("n", F.lit(0)).alias("infections"),
            )
        )


_INFECTIONS = ", ".join(
    f"CASE WHEN c_nationkey = 7 AND {m} = 3 THEN 'n.a.' ELSE CAST(count(*) FILTER (month(o_orderdate) = {m}) AS VARCHAR) END AS Infection_{m}"
    for m in MONTHS
)
_DEATHS = ", ".join(
    f"CAST(count(*) FILTER (month(o_orderdate) = {m} AND o_orderpriority = '1-URGENT') AS VARCHAR) AS Death_{m}"
    for m in MONTHS
)

SQL = {
    "zones": """
        SELECT n_nationkey AS zone_id, n_name AS zone_name, r_name AS Region,
               CAST(n_nationkey % 5 AS DOUBLE) AS x0, CAST(n_nationkey // 5 AS DOUBLE) AS y0
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "placed_orders": "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey",
    "panel": f"""
        SELECT c_nationkey AS zone_id, CAST(o_orderdate AS DATE) AS date,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / {UNIT} AS price_MEAN,
               min(o_totalprice) / {UNIT} AS price_min_MEAN, max(o_totalprice) / {UNIT} AS price_max_MEAN
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey, CAST(o_orderdate AS DATE)""",
    "full_panel": """
        SELECT t.zone_id, t.date, p.price_MEAN, p.price_min_MEAN,
               CASE WHEN day(t.date) % 2 = 1 THEN p.price_max_MEAN END AS price_max_MEAN
        FROM (SELECT n_nationkey AS zone_id, CAST(d AS DATE) AS date
              FROM nation, (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)),
                            max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)) t
        LEFT JOIN panel p ON p.zone_id = t.zone_id AND p.date = t.date""",
    "cases": """
        SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS onset,
               CASE WHEN o_orderstatus = 'P' THEN '是' ELSE '否' END AS imported,
               c_mktsegment AS county, o_orderpriority AS town,
               CASE WHEN c_nationkey <> 24 THEN c_nationkey END AS zone_id,
               year(o_orderdate) AS year
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "local_counts": """
        SELECT year, zone_id, count(*) AS infections FROM cases
        WHERE zone_id IS NOT NULL GROUP BY year, zone_id""",
    "population": """
        SELECT year, zone_id,
               CASE WHEN zone_id = 3 THEN 'n/a' WHEN zone_id = 4 THEN '0'
                    ELSE CAST(p + year - 1996 AS VARCHAR) END AS p_cnt,
               m AS m_cnt, p - m AS f_cnt
        FROM (SELECT c_nationkey AS zone_id, count(*) AS p,
                     count(*) FILTER (c_custkey % 2 = 0) AS m
              FROM customer GROUP BY c_nationkey),
             (SELECT unnest(range(1995, 2002)) AS year)""",
    "traps": """
        SELECT l_shipdate AS start_time, l_returnflag AS district, s_nationkey AS zone_id,
               l_quantity AS avg_eggs
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "points": """
        SELECT c_custkey AS point_id, (c_custkey * 7919 % 5000) / 1000.0::DOUBLE AS x,
               (c_custkey * 104729 % 5000) / 1000.0::DOUBLE AS y, c_acctbal AS value,
               CAST(2015 + c_custkey % 5 AS INTEGER) AS year
        FROM customer""",
    "placed_points": """
        SELECT p.*, z.zone_id FROM points p JOIN zones z
        ON p.x BETWEEN z.x0 AND z.x0 + 1 AND p.y BETWEEN z.y0 AND z.y0 + 1""",
    "pixels": f"""
        SELECT CASE WHEN l_linenumber = 1 THEN 'A' ELSE 'B' END AS dataset,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS image_date,
               (l_partkey * 7919 % 5000) / 1000.0::DOUBLE AS x,
               (l_orderkey * 104729 % 5000) / 1000.0::DOUBLE AS y,
               l_extendedprice / {UNIT} AS NDVI,
               CASE WHEN l_linenumber <> 7 THEN l_quantity / {UNIT} END AS EVI,
               CAST(l_partkey % 256 AS INTEGER) AS SummaryQA,
               CAST(l_partkey % 256 AS INTEGER) AS QC_Day,
               CAST(l_suppkey * 7 % 256 AS INTEGER) AS QC_Night
        FROM lineitem""",
    "placed_pixels": """
        SELECT p.*, z.zone_id FROM pixels p JOIN zones z
        ON p.x BETWEEN z.x0 AND z.x0 + 1 AND p.y BETWEEN z.y0 AND z.y0 + 1""",
    "land_pixels": f"""
        SELECT p_partkey % 25 AS zone_id, ({LAND_COVER_CLASSES})[p_size % 10 + 1] AS class_code,
               CAST(p_retailprice AS DECIMAL(18,2)) AS area
        FROM part""",
    "sheets": f"""
        SELECT year(o_orderdate) AS year, c_nationkey + 1 AS row_no,
               'Province ' || (c_nationkey % 5) AS Province, 'City ' || c_nationkey AS City,
               {_INFECTIONS}, {_DEATHS}
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY year(o_orderdate), c_nationkey""",
    "customer_counts": """
        SELECT c_custkey AS zone_id,
               count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS deaths,
               count(o_orderkey) AS infections
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
}

_NEEDS = {
    "full_panel": ["panel"],
    "local_counts": ["cases"],
    "placed_points": ["points", "zones"],
    "placed_pixels": ["pixels", "zones"],
}


def with_inputs(names: str, body: str) -> str:
    """SQL for ``body`` with the named inputs (and what they need) in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{n} AS ({SQL[n]})" for n in order]
    extra = body.lstrip()
    if not ctes:
        return extra
    if extra.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {extra[5:]}"
    return f"WITH {', '.join(ctes)} {extra}"


def rd(expr: str, digits: int = 6) -> str:
    """SQL twin of ``r``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE)"
