"""An elem view over the `events` table: routing columns by arithmetic, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aspath, community, ip

VIEW = """
SELECT event_id, {T} AS time_us,
  CASE WHEN event_type = 'view' THEN 'R' ELSE 'U' END AS rec_type,
  CASE event_type WHEN 'view' THEN 'R' WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'W' ELSE 'S' END AS elem_type,
  CASE WHEN event_id % 2 = 0 THEN 'ris' ELSE 'routeviews' END AS project,
  concat('rrc', CAST(event_id % 5 AS STRING)) AS collector,
  CAST(64512 + user_id AS BIGINT) AS peer_asn,
  CAST(16 + event_id % 9 AS INT) AS len,
  CAST(ip - ip % CAST(power(2, 16 - event_id % 9) AS BIGINT) AS BIGINT) AS net,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN concat_ws(' ', CAST(64512 + user_id AS STRING), CAST(3000 + event_id % 7 AS STRING), CAST(20000 + event_id % 50 AS STRING)) END AS as_path,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN concat(CAST(2900 + user_id % 20 AS STRING), ':', CAST(event_id % 1000 AS STRING)) END AS communities
FROM (SELECT *, CAST(167772160 + user_id * 65536 + (event_id % 256) * 256 AS BIGINT) AS ip FROM {events}) e
"""
DUCK_VIEW = VIEW.replace("{T}", "epoch_us(ts)").replace("{events}", "events")


def elem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as in DUCK_VIEW, the texts as `as_path` and `communities_text`, and the engine's own values beside them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(VIEW.replace("{T}", "unix_micros(CAST(ts AS TIMESTAMP))"), events=events)
    rows = rows.withColumn("prefix", ip.v4_prefix(F.col("net"), F.col("len")))
    rows = rows.withColumn("path", aspath.parse_path(F.col("as_path"))).withColumn("communities_text", F.col("communities")).withColumn("communities", community.parse_communities(F.col("communities")))
    return rows.withColumn("time_sec", F.expr("time_us div 1000000")).withColumn("time_usec", F.expr("CAST(time_us % 1000000 AS INT)"))


def supplier_roas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin attestations from `supplier`: one of several snapshots, an AS number, an IPv4 prefix and its longest length."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    net = "CAST(167772160 + (s_suppkey % 150) * 65536 AS BIGINT)"
    rows = supplier.selectExpr("CAST(1704067200 + (s_suppkey % 7) * 345600 AS BIGINT) AS snapshot", "CAST(20000 + s_nationkey * 2 AS BIGINT) AS asn", f"{net} AS net", "CAST(16 + s_suppkey % 9 AS INT) AS max_length")
    return rows.select("snapshot", "asn", ip.v4_prefix(F.col("net"), F.lit(16)).alias("prefix"), "max_length").distinct()


DUCK_ROAS = """
SELECT DISTINCT CAST(1704067200 + (s_suppkey % 7) * 345600 AS BIGINT) AS snapshot, CAST(20000 + s_nationkey * 2 AS BIGINT) AS asn,
  CAST(167772160 + (s_suppkey % 150) * 65536 AS BIGINT) AS net, CAST(16 + s_suppkey % 9 AS INT) AS max_length FROM supplier
"""
