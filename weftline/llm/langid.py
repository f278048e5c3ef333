"""Language of web pages: Bayesian fusion of text, markup, address and host evidence.

The posterior of a page's language is the product of

*  the likelihood of its whole visible text under models of hashed byte
   trigrams, tempered because neighbouring trigrams aren't independent;
*  the likelihood of its declared markup language, and of its address suffix,
   under each language, estimated by grouping all pages;
*  a host prior, smoothed towards the prior of its domain, which is smoothed
   towards that of all pages.  A page's own share is taken out of its host's
   and domain's counts, so that no evidence counts twice.

All counts are sums of text posteriors over every page, by grouped aggregation;
nothing is collected but the models.  The text models are fitted on about
``sample`` labelled documents of each language, or all that it has (chosen by
the hash of the id), and hold 2**bits counts for each language.

Defined cases: null or empty html gives no text evidence, so that the other
evidence decides; a null or odd url has the empty host; a missing declaration is
a value of its own; ties go to the language that sorts first; repeated rows are
scored alike; a very long page is read whole; an empty table gives an empty result; without any labelled
document the language is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import save, work_dir
from weftline.llm.textkit import LOWER, text_slices


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    sample: int = 20_000  # documents of each language
    temper: float = 0.1  # weight of a trigram's log-likelihood
    host_weight: float = 4.0  # pages that a domain's prior counts for in its hosts
    domain_weight: float = 16.0
    smoothing: float = 1.0


#: what isn't visible text, and how a declaration is found
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*+>"
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])"


def trigrams(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each byte trigram inside a row; runs of non-letters are one blank."""
    low = LOWER[raw]
    letter = (low >= 128) | ((low >= 97) & (low <= 122))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low = np.where(letter, low, 32)
    keep = letter.copy()
    keep[:1] = True  # as at the start of any row
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    low, row = low[keep].astype(np.uint32), row[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)
    inside = row[:-2] == row[2:]
    return bucket[inside], row[:-2][inside]


def _count(bits: int, languages: list[str]):
    at = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) << bits)
        for batch in batches:
            lang = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            for lo, _, raw, offsets in text_slices(batch.column(1)):
                bucket, row = trigrams(raw, offsets, bits)
                total += np.bincount((lang[lo + row] << bits) + bucket, minlength=len(total))
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    return run


def text_models(docs: DataFrame, s: Settings, parts: int = 8) -> tuple[list[str], np.ndarray]:
    """Languages, and (language, bucket) log-probabilities."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("at"))
    by = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(by)
    if not languages:
        return [], np.zeros((0, 1 << s.bits))
    # the share of a language that makes ``sample`` of its documents
    most = F.create_map(*[F.lit(v) for x, n in by.items() for v in (x, int(min(1.0, s.sample / n) * (1 << 30)))])
    some = rows.where(F.col("at") <= most[F.col("lang")]).select("lang", "text").repartition(parts)
    total = np.zeros(len(languages) << s.bits)
    for r in some.mapInArrow(_count(s.bits, languages), "counts binary").collect():  # at most ``parts`` of a fixed size
        total += np.frombuffer(r[0])
    counts = total.reshape(len(languages), -1) + s.smoothing / 16
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def _likelihoods(model: np.ndarray, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model)
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch.column(4)):
                bucket, row = trigrams(raw, offsets, s.bits)
                ll = np.column_stack([np.bincount(row, m[bucket], hi - lo) for m in model]) * s.temper
                ll -= ll.max(1, keepdims=True)
                post = np.exp(ll)
                post /= post.sum(1, keepdims=True)
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * n)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (ll, post)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(4)), *lists], names=["page_id", "host", "suffix", "declared", "ll", "post"])

    return run


def _sums(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.array(*[F.sum(F.col("post")[k]) for k in range(n)]).alias(name))


def languages(pages: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, language, confidence, text_language, declared_language, host) for every page.

    ``pages`` has page_id, url and html; ``docs`` has doc_id, lang and text, and teaches the text models.
    """
    s, folder = settings, work_dir(pages.sparkSession, "langid")
    names, model = text_models(docs, s)
    n = len(names)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"),
        F.substring_index(host, ".", -1).alias("suffix"),
        F.lower(F.coalesce(F.regexp_extract("html", DECLARED, 1), F.lit(""))).alias("declared"),
        F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, " ").alias("text"),
    )
    if not n:
        none = F.lit(None).cast("string")
        return page.select("page_id", none.alias("language"), F.lit(None).cast("double").alias("confidence"), none.alias("text_language"), F.nullif("declared", F.lit("")).alias("declared_language"), "host")
    read = "page_id long, host string, suffix string, declared string, ll array<double>, post array<double>"
    scored = save(page.mapInArrow(_likelihoods(model, s), read).withColumn("domain", F.substring_index("host", ".", -2)), f"{folder}/scored")
    tables = {k: save(_sums(scored, k, n, f"n_{k}"), f"{folder}/{k}") for k in ("host", "domain", "suffix", "declared")}
    # one row for all pages
    every = tables["suffix"].agg(*[F.sum(F.col("n_suffix")[k]) for k in range(n)]).first()
    overall = [float(x or 0) + s.smoothing for x in every]
    prior = [x / sum(overall) for x in overall]
    kinds = {k: tables[k].count() for k in ("suffix", "declared")}
    out = scored
    for k in tables:
        out = out.join(tables[k].withColumnRenamed(k, f"k_{k}"), F.col(k) == F.col(f"k_{k}"), "left").drop(f"k_{k}")
    # counts without the page's own share
    own = lambda col, k: F.greatest(F.col(col)[k] - F.col("post")[k], F.lit(0.0))
    size = lambda col: sum((own(col, k) for k in range(n)), F.lit(0.0))
    out = out.withColumns({"s_domain": size("n_domain"), "s_host": size("n_host")})
    logs = []
    for k in range(n):
        domain = (own("n_domain", k) + s.domain_weight * prior[k]) / (F.col("s_domain") + s.domain_weight)
        at_host = (own("n_host", k) + s.host_weight * domain) / (F.col("s_host") + s.host_weight)
        term = F.col("ll")[k] + F.log(at_host)
        for kind, width in kinds.items():
            term = term + F.log((own(f"n_{kind}", k) + s.smoothing) / (F.lit(overall[k]) + s.smoothing * (width + 1)))
        logs.append(term)
    out = out.withColumn("lp", F.array(*logs)).withColumn("top", F.array_max("lp"))
    best = F.array_position("lp", F.col("top")).cast("int")
    said = F.array(*[F.lit(x) for x in names])
    return out.select(
        "page_id",
        F.get(said, best - 1).alias("language"),
        (1 / F.expr("aggregate(lp, double(0), (a, x) -> a + exp(x - top))")).alias("confidence"),
        F.get(said, F.array_position("post", F.array_max("post")).cast("int") - 1).alias("text_language"),
        F.nullif("declared", F.lit("")).alias("declared_language"),
        "host",
    )
