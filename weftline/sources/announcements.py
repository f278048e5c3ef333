"""Announcements: raw JSON to flat rows, deduplication, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from weftline.functions.text import joined_text

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("NEWSID", "SCRIP_CD", "DT_TM", "NEWS_DT", "HEADLINE", "NEWSSUB", "CATEGORYNAME", "SUBCATNAME", "PDFFLAG", "ATTACHMENTNAME")])
RESPONSE = T.StructType([T.StructField("Table", T.ArrayType(RAW)), T.StructField("Table1", T.ArrayType(T.StructType([T.StructField("ROWCNT", T.LongType())])))])
ANNOUNCEMENT = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("news_id", "ticker", "scrip_code")],
        T.StructField("date", T.DateType()),
        *[T.StructField(c, T.StringType()) for c in ("headline", "subject", "text", "category", "subcategory")],
        T.StructField("has_pdf", T.BooleanType()),
        T.StructField("pdf_url", T.StringType()),
    ]
)
DOCUMENT = T.StructType([T.StructField("source_type", T.StringType()), T.StructField("primary_ticker", T.StringType()), T.StructField("published", T.DateType()), T.StructField("text", T.StringType()), T.StructField("url", T.StringType())])
RELATION = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("confidence", T.DoubleType())])


def flatten(raw: DataFrame, attachments: str = "") -> DataFrame:
    """Rows of ANNOUNCEMENT from (ticker, ann), ``ann`` a struct like RAW; ``attachments`` is the base of their addresses."""
    text = lambda c: F.coalesce(F.col(f"ann.{c}"), F.lit(""))
    headline, subject, attached = F.trim(text("HEADLINE")), F.trim(text("NEWSSUB")), F.trim(text("ATTACHMENTNAME"))
    when = F.coalesce(F.nullif(F.col("ann.DT_TM"), F.lit("")), F.col("ann.NEWS_DT"))
    return raw.select(
        F.col("ann.NEWSID").alias("news_id"),
        "ticker",
        text("SCRIP_CD").alias("scrip_code"),
        F.try_to_timestamp(when).cast("date").alias("date"),
        headline.alias("headline"),
        subject.alias("subject"),
        joined_text(headline, subject).alias("text"),
        text("CATEGORYNAME").alias("category"),
        text("SUBCATNAME").alias("subcategory"),
        (F.coalesce(F.expr("try_cast(ann.PDFFLAG as int)"), F.lit(0)) != 0).alias("has_pdf"),
        F.when(attached != "", F.concat(F.lit(attachments), attached)).otherwise("").alias("pdf_url"),
    )


def from_responses(responses: DataFrame, column: str = "json", attachments: str = "") -> DataFrame:
    """Flat rows from (ticker, json), each the text of one response page."""
    parsed = responses.select("ticker", F.explode(F.from_json(column, RESPONSE)["Table"]).alias("ann"))
    return flatten(parsed, attachments)


def first_of_each(rows: DataFrame, key: str = "news_id", order: str = "seq") -> DataFrame:
    """The first row of each key; rows without one count as one key."""
    n = F.row_number().over(W.Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def per_year(rows: DataFrame) -> DataFrame:
    return rows.where("date is not null").groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def extract_relations(docs: DataFrame) -> DataFrame:
    """Relations between companies: the schema is fixed, an extractor isn't part of it, so there is none."""
    return docs.sparkSession.createDataFrame([], RELATION)
