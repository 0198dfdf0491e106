"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import conversation_digests
from .common import table
from .decontaminate import contained_items
from .langid import language_ids
from .licenses import license_labels
from .oracles import ORACLES as ORACLES
from .packing import pack
from .quality import quality_rules
from .repeats import remove_repeats
from .secrets import secret_digests
from .sharding import shard_documents
from .simhash import simhash_classes


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select cast(-7 as bigint) conv_id, cast(id as bigint) turn, if(id = 0, 'user', 'assistant') role, '{said}' text from range(2)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(rows.unionByName(own))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer_path())


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_repeats": op4_repeats,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_licenses": op7_licenses,
    "op8_langid": op8_langid,
    "op9_chat": op9_chat,
    "op10_packing": op10_packing,
}
