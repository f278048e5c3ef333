"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table, work_dir


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.tokenfile import read_token_index, write_token_files

    out = work_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_index(spark, out)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.langid import languages

    return languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.warc import read_archives, write_archives

    out = work_dir(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), out)
    return read_archives(spark, out)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.covertree import cosine_links

    return cosine_links(table(spark, sf_dir, "embeddings"))


def op8_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.runindex import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.minhash import Scheme, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Scheme(percent=85))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_decontaminate": op2_decontaminate,
        "op3_pii": op3_pii,
        "op4_language": op4_language,
        "op5_warc": op5_warc,
        "op6_quality": op6_quality,
        "op7_cover_tree": op7_cover_tree,
        "op8_run_index": op8_run_index,
        "op9_minhash": op9_minhash,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    """None yet: no operator here has a form that DuckDB runs over whole tables in bounded time."""
    return {}
