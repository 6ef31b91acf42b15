"""The driver's tables read as episodes, and the same in SQL.

An episode is an order; its tool trace is its line items; a session is a customer's orders by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import duration_minutes, per_action


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey") % 4
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("target"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("anchor"),
        F.when(part == 0, "verify").when(part == 1, "modify").when(part == 2, "execute").otherwise("retrieve").alias("class"),
        (F.col("l_returnflag") != "N").alias("completed"),
        (F.col("l_discount") < 0.08).alias("succeeded"),
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("completed") & F.col("succeeded")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    calls = trace(spark, sf_dir).groupBy("ok").agg(
        F.count(F.lit(1)).alias("calls"),
        F.max("l_shipdate").alias("ended"),
        F.count_if(done & (F.col("class") != "retrieve")).alias("actions"),
        flag(done & (F.col("class") == "verify")).alias("verification_successful"),
        flag(F.col("l_partkey") % 5 == 0).alias("audit_signal"),
        flag(F.col("l_suppkey") % 3 == 0).alias("remediation_signal"),
        flag(F.col("l_partkey") % 11 == 0).alias("packaging_release_signal"),
        flag(done & (F.col("class") == "retrieve")).alias("grounded_decision_trace"),
    )
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.col("o_orderkey") % 4
    ep = orders.join(calls, F.col("o_orderkey") == F.col("ok")).select(
        F.col("o_orderkey").alias("episode_id"),
        F.concat(F.lit("ST"), F.lpad((F.col("c_nationkey") % 13).cast("string"), 2, "0")).alias("station_id"),
        F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1).cast("int") % 2).alias("provider"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month"),
        F.when(kind == 0, "candidate_strong").when(kind == 1, "candidate_probable").otherwise("exclude_no_context_operation").alias("disposition"),
        F.lit("direct_or_unresolved_user_level").alias("origin"),
        F.lit("no").alias("publication"),
        F.col("o_custkey").alias("session_ref"),
        F.col("o_orderdate").alias("started"),
        "ended",
        (F.expr("o_orderkey div 4") % 3 == 0).alias("cue"),
        (F.expr("o_orderkey div 8") % 3 != 0).alias("frontloaded"),
        "calls",
        "actions",
        "verification_successful",
        "audit_signal",
        "remediation_signal",
        "packaging_release_signal",
        "grounded_decision_trace",
    )
    ep = ep.withColumn("multistage_signal", (F.col("audit_signal") + F.col("remediation_signal") + F.col("packaging_release_signal") >= 2).cast("int"))
    ep = ep.withColumn("duration_min", duration_minutes(F.col("started"), F.col("ended"))).withColumn("completed_substantive_actions", F.col("actions").cast("double"))
    return ep.withColumn("min_per_action", per_action(F.col("duration_min"), F.col("actions")))


def with_turns(ep: DataFrame) -> DataFrame:
    """Turn in the session, by start and id. A customer's orders are few; a transcript's turns come with it."""
    return ep.withColumn("turn", F.row_number().over(Window.partitionBy("session_ref").orderBy("started", "episode_id")))


EPISODES_SQL = """
tr AS (SELECT l_orderkey AS ok, 'P' || l_partkey AS target, 'S' || l_suppkey AS anchor,
         CASE l_partkey % 4 WHEN 0 THEN 'verify' WHEN 1 THEN 'modify' WHEN 2 THEN 'execute' ELSE 'retrieve' END AS class,
         l_returnflag <> 'N' AS completed, l_discount < 0.08 AS succeeded, l_partkey, l_suppkey, l_shipdate FROM lineitem),
ag AS (SELECT ok, count(*) AS calls, max(l_shipdate) AS ended,
         count(*) FILTER (WHERE completed AND succeeded AND class <> 'retrieve') AS actions,
         max(CASE WHEN completed AND succeeded AND class = 'verify' THEN 1 ELSE 0 END) AS verification_successful,
         max(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) AS audit_signal,
         max(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS remediation_signal,
         max(CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END) AS packaging_release_signal,
         max(CASE WHEN completed AND succeeded AND class = 'retrieve' THEN 1 ELSE 0 END) AS grounded_decision_trace
       FROM tr GROUP BY ok),
e0 AS (SELECT o_orderkey AS episode_id, 'ST' || lpad(CAST(c_nationkey % 13 AS VARCHAR), 2, '0') AS station_id,
         'P' || (CAST(substr(o_orderpriority, 1, 1) AS INT) % 2) AS provider, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month,
         CASE o_orderkey % 4 WHEN 0 THEN 'candidate_strong' WHEN 1 THEN 'candidate_probable' ELSE 'exclude_no_context_operation' END AS disposition,
         o_custkey AS session_ref, o_orderdate AS started, ended, (o_orderkey // 4) % 3 = 0 AS cue, (o_orderkey // 8) % 3 <> 0 AS frontloaded,
         calls, actions, verification_successful, audit_signal, remediation_signal, packaging_release_signal, grounded_decision_trace,
         CASE WHEN audit_signal + remediation_signal + packaging_release_signal >= 2 THEN 1 ELSE 0 END AS multistage_signal,
         greatest(0.0, CAST(date_diff('microsecond', o_orderdate, ended) AS DOUBLE) / 6e7) AS duration_min,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN ag ON ok = o_orderkey),
ep AS (SELECT *, CAST(actions AS DOUBLE) AS completed_substantive_actions, CASE WHEN actions > 0 THEN duration_min / actions END AS min_per_action FROM e0)
"""

BINARY = ("verification_successful", "audit_signal", "remediation_signal", "packaging_release_signal", "multistage_signal", "grounded_decision_trace")
RATIO = ("duration_min", "completed_substantive_actions", "min_per_action")
