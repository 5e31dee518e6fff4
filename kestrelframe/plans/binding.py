"""Driver tables in the shapes that the operators take, in Spark and as DuckDB CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows: its CTEs are put before it, and it may go on with ``, more AS (...)``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            used = [cte for word, cte in CTES.items() if re.search(rf"\b{word}(?!\w)", sql)]
            if used:
                ORACLE_SQL[name] = "WITH " + ",\n".join(used) + sql
            else:
                ORACLE_SQL[name] = re.sub(r"^\s*,", "WITH ", sql)
        return f

    return add


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.extract(F.lit("SECOND"), ts).cast("double")


CTES = {
    "ev_": "ev_ AS (SELECT event_type AS stream, event_id AS seq, epoch(ts) AS t, value AS v, user_id FROM events)",
    "pts_": "pts_ AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, l_discount * 500 AS y, l_extendedprice / 1000 AS z, l_linenumber * 30 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)",
    "emb_": "emb_ AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z, label FROM embeddings)",
    "jobs_": "jobs_ AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, epoch(o_orderdate) AS created, epoch(o_orderdate) + o_orderkey % 200 AS updated FROM orders)",
    "projects_": "projects_ AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey % 5 = 0 THEN 1.0 END AS archived_at FROM customer)",
    "frames_": "frames_ AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS idx, p_retailprice / 25 AS sharpness, CAST(p_size AS DOUBLE) AS motion, p_size % 7 AS dark FROM part)",
}


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), epoch(F.col("ts")).alias("t"), F.col("value").alias("v"), "user_id")


def pts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"),
        (F.col("l_linenumber") * 30).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("b"),
    )


def emb(spark: SparkSession, d: str) -> DataFrame:
    c = lambda k: F.get("embedding", F.lit(k)).cast("double") * 10
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), c(0).alias("x"), c(1).alias("y"), c(2).alias("z"), "label")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    t = epoch(F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.when(s == "O", "running").when(s == "F", "completed").otherwise("failed").alias("status"), t.alias("created"), (t + F.col("o_orderkey") % 200).alias("updated"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 5 == 0, 1.0).alias("archived_at"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    low = p.agg(F.min("p_partkey").alias("_m"))
    return p.crossJoin(F.broadcast(low)).select((F.col("p_partkey") - F.col("_m")).alias("idx"), (F.col("p_retailprice") / 25).alias("sharpness"), F.col("p_size").cast("double").alias("motion"), (F.col("p_size") % 7).alias("dark"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
