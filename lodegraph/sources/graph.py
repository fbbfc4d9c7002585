"""Relational tables as a property graph: nodes and edges as DataFrames, all lazy.

Nodes: S<suppkey> and C<custkey> are companies, P<partkey> products, N<nationkey> organisations, E<event_id> events.
Only the columns that a projection needs are read, so scans stay narrow.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the line table that one task takes up; tables of any size have tasks of this size.
ROWS_A_TASK = 250_000


def tasks_of(spark: SparkSession, rows: int) -> int:
    """As many tasks as so many rows need."""
    return max(min(spark.sparkContext.defaultParallelism, math.ceil(rows / 50_000)), math.ceil(rows / ROWS_A_TASK), 1)


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """tasks_of() the lines, with which edges and impacts grow."""
    return tasks_of(spark, table(spark, sf_dir, "lineitem").count())


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys over as many tasks as so many rows need: left to itself, Spark merges tasks until their memory grows with the table."""
    return df.repartition(tasks_of(df.sparkSession, rows), *keys)


def over(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df by keys over so many tasks, or as it is: for joins whose rows in are few and rows out are many."""
    return df.repartition(tasks, *keys) if tasks else df


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/lodegraph-checkpoints"
    return found.rstrip("/")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, label, name, sector): companies, organisations and products."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("sector"))
    s = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("nk")).select(key("S", "s_suppkey").alias("key"), F.lit("Company").alias("label"), F.col("s_name").alias("name"), "sector")
    c = t("customer").select(key("C", "c_custkey").alias("key"), F.lit("Company").alias("label"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    p = t("part").select(key("P", "p_partkey").alias("key"), F.lit("Product").alias("label"), F.col("p_name").alias("name"), F.element_at(F.split("p_type", " "), 1).alias("sector"))
    n = t("nation").select(key("N", "n_nationkey").alias("key"), F.lit("Organization").alias("label"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("sector"))
    return s.unionByName(c).unionByName(p).unionByName(n)


def supply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: the supplier, the customer, and what the edge is made of."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_discount", "l_linenumber")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return line.join(order, "l_orderkey")


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUPPLIES_TO edges, one per supplier, customer and return flag, with provenance and audit marks.

    Lines are dealt by both ends, so neither the edges nor what groups them by their ends is shuffled again.
    """
    last, first = F.max("l_shipdate"), F.min("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").count()
    ends = supply_lines(spark, sf_dir).select(key("S", "l_suppkey").alias("src"), key("C", "o_custkey").alias("tgt"), "l_orderkey", "l_returnflag", "l_shipdate", "l_discount")
    g = dealt(ends, rows, "src", "tgt").groupBy("src", "tgt", "l_returnflag").agg(
        F.count_distinct("l_orderkey").cast("int").alias("corroboration"), last.alias("last"), first.alias("first"), F.max(F.round(F.col("l_discount") * 100)).cast("int").alias("d"), F.min("l_orderkey").alias("doc")
    )
    number = lambda c: F.substring(c, 2, 20).cast("long")
    flag, supplier, customer = F.col("l_returnflag"), number("src"), number("tgt")
    both = supplier + customer
    return g.select(
        F.concat_ws("|", "src", F.lit("SUPPLIES_TO"), "tgt", "l_returnflag").alias("edge_id"),
        "src",
        "tgt",
        F.lit("SUPPLIES_TO").alias("type"),
        flag.alias("subtype"),
        ((10 - F.col("d")) / 10).alias("confidence"),
        "corroboration",
        day(F.col("first")).alias("first_seen"),
        day(F.col("last")).alias("last_seen"),
        F.when(flag == "R", day(F.date_add("last", 300))).alias("valid_until"),
        F.when(customer % 13 == 0, F.lit(None)).otherwise(~((flag == "A") & (supplier % 5 == 0))).alias("is_current"),
        F.when(flag == "N", 365).when(flag == "R", 180).otherwise(0).alias("refresh_cycle_days"),
        (both % 11 == 0).alias("suspect"),
        F.when(both % 33 == 0, "wrong_type").when(both % 33 == 11, "insufficient").alias("stage1"),
        F.when(flag == "N", "dart").when(flag == "R", "dart_filing").otherwise("news").alias("source_type"),
        F.concat(F.lit("order-"), F.col("doc").cast("string")).alias("source_doc"),
    )


def simple_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, type): DEVELOPS, DEPENDS_ON and REGULATES."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.count()
    # told apart as numbers, and only where they meet: a map of a whole split's pairs would hold nearly all of its rows
    distinct = lambda df, *ends: dealt(df.select(*ends), rows, *ends).distinct()
    develops = distinct(line, "l_suppkey", "l_partkey").select(key("S", "l_suppkey").alias("src"), key("P", "l_partkey").alias("tgt"), F.lit("DEVELOPS").alias("type"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = line.select("l_orderkey", "l_partkey").join(order, "l_orderkey")
    depends = distinct(bought, "o_custkey", "l_partkey").select(key("C", "o_custkey").alias("src"), key("P", "l_partkey").alias("tgt"), F.lit("DEPENDS_ON").alias("type"))
    regulates = table(spark, sf_dir, "supplier").select(key("N", "s_nationkey").alias("src"), key("S", "s_suppkey").alias("tgt")).withColumn("type", F.lit("REGULATES"))
    return develops.unionByName(depends).unionByName(regulates)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, is_risk, occurred_at, company, value, k)."""
    e = table(spark, sf_dir, "events")
    return e.select(key("E", "event_id").alias("event_id"), "event_type", (F.col("event_type") == "error").alias("is_risk"), day(F.col("ts")).alias("occurred_at"), key("C", "user_id").alias("company"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def main_suppliers(edges: DataFrame) -> DataFrame:
    """(company, supplier): the supplier with most orders for each company, the least key of equals."""
    total = edges.groupBy("tgt", "src").agg(F.sum("corroboration").alias("n"))
    best = total.groupBy("tgt").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("src"))).alias("b"))
    return best.select(F.col("tgt").alias("company"), F.col("b.src").alias("supplier"))


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMPACTS edges: an event reaches the main supplier of its company."""
    e = events(spark, sf_dir)
    reach = main_suppliers(supplies(spark, sf_dir))
    sign = F.when(F.col("is_risk"), "negative").when(F.col("event_type") == "purchase", "positive")
    return e.join(reach, "company").select("event_id", "event_type", "is_risk", "occurred_at", F.col("company").alias("origin"), F.col("supplier").alias("target"), sign.alias("sign"), (F.col("k") / 100).alias("confidence"))


#: The same projection in the SQL of the oracle, as named tables for a WITH clause.
SQL = """
supplies AS (
  SELECT concat_ws('|', 'S' || l_suppkey, 'SUPPLIES_TO', 'C' || o_custkey, l_returnflag) AS edge_id,
    'S' || l_suppkey AS src, 'C' || o_custkey AS tgt, 'SUPPLIES_TO' AS type, l_returnflag AS subtype,
    (10 - max(CAST(round(l_discount * 100) AS INT))) / 10 AS confidence,
    CAST(count(DISTINCT l_orderkey) AS INT) AS corroboration,
    strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen,
    CASE WHEN l_returnflag = 'R' THEN strftime(max(l_shipdate) + INTERVAL 300 DAY, '%Y-%m-%d') END AS valid_until,
    CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE NOT (l_returnflag = 'A' AND l_suppkey % 5 = 0) END AS is_current,
    CASE l_returnflag WHEN 'N' THEN 365 WHEN 'R' THEN 180 ELSE 0 END AS refresh_cycle_days,
    (l_suppkey + o_custkey) % 11 = 0 AS suspect,
    CASE (l_suppkey + o_custkey) % 33 WHEN 0 THEN 'wrong_type' WHEN 11 THEN 'insufficient' END AS stage1,
    CASE l_returnflag WHEN 'N' THEN 'dart' WHEN 'R' THEN 'dart_filing' ELSE 'news' END AS source_type,
    'order-' || min(l_orderkey) AS source_doc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey, l_returnflag),
nodes AS (
  SELECT 'S' || s_suppkey AS key, 'Company' AS label, s_name AS name, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'Company', c_name, c_mktsegment FROM customer
  UNION ALL SELECT 'P' || p_partkey, 'Product', p_name, string_split(p_type, ' ')[1] FROM part
  UNION ALL SELECT 'N' || n_nationkey, 'Organization', n_name, NULL FROM nation),
simple_edges AS (
  SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, 'DEVELOPS' AS type FROM lineitem
  UNION ALL SELECT DISTINCT 'C' || o_custkey, 'P' || l_partkey, 'DEPENDS_ON' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'REGULATES' FROM supplier),
ev AS (
  SELECT 'E' || event_id AS event_id, event_type, event_type = 'error' AS is_risk, strftime(ts, '%Y-%m-%d') AS occurred_at,
    'C' || user_id AS company, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
main_suppliers AS (
  SELECT tgt AS company, src AS supplier FROM (
    SELECT tgt, src, row_number() OVER (PARTITION BY tgt ORDER BY sum(corroboration) DESC, src) AS r FROM supplies GROUP BY tgt, src) WHERE r = 1),
impacts AS (
  SELECT event_id, event_type, is_risk, occurred_at, ev.company AS origin, supplier AS target,
    CASE WHEN is_risk THEN 'negative' WHEN event_type = 'purchase' THEN 'positive' END AS sign, k / 100 AS confidence
  FROM ev JOIN main_suppliers m ON ev.company = m.company)
"""
