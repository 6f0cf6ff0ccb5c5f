"""What the query modules share: tables, the zone-by-month panel, and a register of queries with their SQL.

Zones are nations, their units customers; the panel counts orders by nation and month.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double"), 6)
    return out.alias(name) if name else out


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, period_month, y, total: orders of a nation in a month."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("zone_id"))
    g = o.join(c, "o_custkey").groupBy("zone_id", F.date_format("o_orderdate", "yyyy-MM").alias("period_month"))
    return g.agg(F.count(F.lit(1)).alias("y"), F.sum("o_totalprice").alias("total"))


PANEL = """panel AS (
    SELECT c_nationkey AS zone_id, strftime(o_orderdate, '%Y-%m') AS period_month,
           CAST(count(*) AS BIGINT) AS y, sum(o_totalprice) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, population, balance, debt_share, building_share, spread: customers of a nation."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("zone_id")).agg(
        F.count(F.lit(1)).alias("population"),
        F.avg("c_acctbal").alias("balance"),
        F.avg((F.col("c_acctbal") < 0).cast("double")).alias("debt_share"),
        F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("building_share"),
        (F.max("c_acctbal") - F.min("c_acctbal")).alias("spread"),
    )


ZONES = """zones AS (
    SELECT c_nationkey AS zone_id, CAST(count(*) AS BIGINT) AS population, avg(c_acctbal) AS balance,
           avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS debt_share,
           avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS building_share,
           max(c_acctbal) - min(c_acctbal) AS spread
    FROM customer GROUP BY 1)"""

#: Splits of the panel by month.
TRAIN_END, VALIDATION_END = "1999-12", "2000-08"
SPLIT = f"CASE WHEN period_month <= '{TRAIN_END}' THEN 'train' WHEN period_month <= '{VALIDATION_END}' THEN 'validation' ELSE 'test' END"
