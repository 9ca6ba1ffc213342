"""Bars, funding and news in the shape of these jobs from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barweave.operators.resample import bucket, ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), (1000 + F.col("value")).alias("price"), F.lit(1).alias("qty"), F.col("event_id").alias("seq"), "user_id", "props")


def bars(spark: SparkSession, sf_dir: str, rule: str = "1h") -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), rule)


def daily_prices(spark: SparkSession, sf_dir: str, asset: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col(asset).cast("string").alias("asset"), F.col("l_shipdate").cast("timestamp").alias("ts"), (1000 + F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("qty"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("seq"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(daily_prices(spark, sf_dir, "l_returnflag"), "1d")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(daily_prices(spark, sf_dir, "l_suppkey"), "1d")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def funding_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), _k().alias("k"))
    return rows.groupBy("asset", bucket("ts", "8h").alias("b")).agg(((F.avg("k") - 50) / 10000).alias("funding_rate")).select("asset", F.col("b").alias("ts"), "funding_rate")


def news_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), _k().alias("k"))
    return rows.groupBy("date").agg((F.avg("k") - 50).alias("news_tone"), F.count("*").cast("double").alias("news_volume")).select(F.lit("all").alias("symbol"), "date", "news_tone", "news_volume")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "1m").withColumn("segment", F.datediff(F.to_date("ts"), F.lit("2020-01-01")))
