"""Stored signals: the daily polarity signal, the daily novelty signal and candidate edges, as Parquet of fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the columns of the stored tables
SCHEMAS = {
    "news_signal": "ticker string, date timestamp, news_count long, news_sentiment double, news_neg_ratio double, news_worst double, news_abs_max double",
    "news_semantic": "ticker string, date timestamp, news_count long, news_novelty double",
    "candidate_edges": "a string, b string, similarity double",
}


def save(rows: DataFrame, kind: str, folder: str) -> str:
    """Write ``rows`` as the table ``kind`` of the folder; days become midnights."""
    columns = [x.split() for x in SCHEMAS[kind].split(", ")]
    path = f"{folder}/{kind}.parquet"
    rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns]).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """The table ``kind`` of the folder, with days as dates."""
    rows = spark.read.schema(SCHEMAS[kind]).parquet(f"{folder}/{kind}.parquet")
    return rows.withColumn("date", F.to_date("date")) if "date" in rows.columns else rows
