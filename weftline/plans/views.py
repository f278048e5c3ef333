"""Domain views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANN_EPOCH = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, price): mean unit price of each brand and week.

    Sums are of decimals, so the price doesn't depend on the order of rows.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    week = F.date_trunc("week", "l_shipdate").cast("date").alias("date")
    return rows.groupBy(week, F.col("p_brand").alias("ticker")).agg((total("l_extendedprice") / total("l_quantity")).alias("price"))


def brand_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, name, sector, grp) of the brands."""
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), number.alias("k")).distinct()
    return brands.select("ticker", F.concat(F.lit("Company "), "ticker").alias("name"), F.concat(F.lit("S"), F.col("k") % 5).alias("sector"), F.concat(F.lit("G"), F.col("k") % 7).alias("grp"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(news_id, ticker, date, text) of the documents."""
    day = F.date_add(F.lit(ANN_EPOCH).cast("date"), (F.col("doc_id") % 30).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("news_id"), F.col("source").alias("ticker"), day.alias("date"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, embedding) of the embeddings."""
    day = F.date_add(F.lit(ANN_EPOCH).cast("date"), (F.col("vec_id") % 20).cast("int"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("T"), "label").alias("ticker"), day.alias("date"), "embedding")
