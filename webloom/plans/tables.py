"""Input relations derived from the star-schema tables by SQL that every engine reads alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATIC = """
SELECT p_partkey AS static_id, 'https://app' || CAST(p_partkey % 7 AS STRING) || '.example.com/' AS entry_url,
  CASE WHEN p_partkey % 11 = 0 THEN '/api/EXPR/' || CAST(p_size AS STRING)
       WHEN p_partkey % 13 = 0 THEN 'https://api' || CAST(p_partkey % 5 AS STRING) || '.example.com/api/' || lower(replace(p_brand, '#', '-')) || '/' || CAST(p_size AS STRING)
       WHEN p_partkey % 17 = 0 THEN '/docs/' || lower(p_type) || '.html'
       ELSE '/api/' || lower(replace(p_brand, '#', '-')) || '/' || CAST(p_size AS STRING) END AS raw_url,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'GET' WHEN 2 THEN 'POST' WHEN 3 THEN 'PUT' ELSE 'GET' END AS method,
  CASE WHEN p_partkey % 3 = 0 THEN 'string' ELSE 'fetch' END AS type, 'ast' AS source,
  'https://app' || CAST(p_partkey % 7 AS STRING) || '.example.com/js/main' || CAST(p_partkey % 3 AS STRING) || '.js' AS source_js_url,
  p_partkey % 4 = 0 AS has_page
FROM part"""

RUNTIME = """
SELECT o_orderkey AS request_id,
  'https://api' || CAST(o_custkey % 5 AS STRING) || '.example.com' || CASE WHEN o_orderkey % 2 = 0 THEN '/gw' ELSE '' END || '/api/brand-' || CAST(o_orderkey % 25 + 1 AS STRING) || '/' || CAST(o_custkey % 50 + 1 AS STRING) AS url,
  CASE o_orderkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'GET' ELSE '' END AS method,
  CASE o_orderkey % 6 WHEN 0 THEN 'XHR' WHEN 1 THEN 'Fetch' WHEN 2 THEN 'EventSource' WHEN 3 THEN 'Script' WHEN 4 THEN 'fetch' ELSE 'xhr' END AS resource_type,
  'https://app' || CAST(o_orderkey % 7 AS STRING) || '.example.com/' AS entry_url,
  CASE WHEN o_custkey % 4 = 0 THEN 'https://app' || CAST(o_orderkey % 7 AS STRING) || '.example.com/js/main' || CAST(o_custkey % 3 AS STRING) || '.js' ELSE '' END AS initiator_url,
  o_custkey % 19 = 0 AS preflight, o_orderkey % 23 = 0 AS websocket, o_custkey % 2 = 0 AS has_page, 200 AS status_code, FALSE AS failed
FROM orders"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """``text`` over the named tables of ``sf_dir``."""
    load(spark, sf_dir, *names)
    return spark.sql(text)


def static_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.array(F.struct(F.lit("page").alias("name"), F.lit("").alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return sql(spark, sf_dir, STATIC, "part").withColumns({"query_params": F.when(F.col("has_page"), page).otherwise(none), "body_params": none})


def runtime_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.array(F.struct(F.lit("page").alias("name"), F.lit("1").alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return sql(spark, sf_dir, RUNTIME, "orders").withColumns(
        {"query_params": F.when(F.col("has_page"), page).otherwise(none), "body_params": none, "stack_urls": F.array().cast("array<string>")}
    )
