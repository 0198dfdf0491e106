"""Corpus preparation in five stages: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlantern.llm import decontaminate, langid, nearcopies, packing, secrets
from eventlantern.llm.common import remove, scratch, table
from eventlantern.llm.queries import tokenizer_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: no letter, null, or an unsure prediction."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every SimHash class, then of every class of near copies at Jaccard 0.8."""
    return nearcopies.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item to the threshold."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row for each piece."""
    return packing.pack(docs.select("doc_id", "text", "source"), tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
ORACLE_SQL = None  # a fitted classifier and a tokenizer have no SQL form; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark, "pipeline")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
