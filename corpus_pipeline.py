"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor wrote and read again.  All but the last
return the columns of ``documents``; the last returns the pieces of sequences
(``pack_documents(..., with_ids=True)`` adds their ids).

Defined cases, as the operators have them: a null or empty text is judged by the
classifier like any other, links with nothing, holds no test item and no personal
data, and is packed as its end id; rows with a null id are never linked and stay;
of repeated rows with words one stays; rows of one id with different texts are
judged each by its own; of tied group members the smallest id stays; a very long
text is read whole by every stage; without labels of both kinds all scores are
equal and all rows stay or go together; empty tables give no pieces; columns
beyond those used pass through under any name, ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, minhash, packing, pii, quality
from weftline.llm.common import save, table, work_dir
from weftline.llm.queries import tokenizer_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more stays."""
    return minhash.keep_one(docs, minhash.Scheme(percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every remaining document has its place in a sequence."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: no SQL expresses the classifier, the tokenizer or the near-duplicate groups over whole tables
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
