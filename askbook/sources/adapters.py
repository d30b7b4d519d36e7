"""Listings, messages and views as the operators want them, made from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last date of the test tables' listings; queries pass it as their as_of.
AS_OF = "2001-11-04"
EPOCH = "1992-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(small: DataFrame) -> DataFrame:
    """The rows spread over all cores, for tables of few bytes whose rows are read as texts: a small table is one file of few row groups."""
    spark = small.sparkSession
    return small.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, channel, brand, model, ref, date, cond, price, stock_code."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    price = F.floor("l_extendedprice").cast("int")
    cond = F.when(F.col("l_returnflag") == "N", "n").when(F.col("l_returnflag") == "A", "p").otherwise("u")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price).alias("id"), (F.col("l_suppkey") % 7).cast("string").alias("channel"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"),
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("ref"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), cond.alias("cond"), price.alias("price"),
        F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("S"), F.col("l_partkey"))).alias("stock_code"),
    )


LISTINGS_SQL = """listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS INT)) AS id, CAST(l_suppkey % 7 AS VARCHAR) AS channel, p_brand AS brand, p_type AS model,
    concat_ws('-', l_partkey, l_linenumber) AS ref, strftime(l_shipdate, '%Y-%m-%d') AS date, CASE l_returnflag WHEN 'N' THEN 'n' WHEN 'A' THEN 'p' ELSE 'u' END AS cond,
    CAST(floor(l_extendedprice) AS INT) AS price, CASE WHEN l_suppkey % 10 = 0 THEN 'S' || l_partkey END AS stock_code
  FROM lineitem JOIN part ON l_partkey = p_partkey
), records AS (SELECT * FROM listings WHERE price BETWEEN 500 AND 500000 AND date >= '1992-01-01')"""
