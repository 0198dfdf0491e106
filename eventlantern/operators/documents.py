"""Search documents: what a record, or a row of text, is to the search operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DISPLAY_FIELDS, load_mapping
from ..functions.analysis import analysed_fields, analysed_text
from ..functions.text import field_name_words
from ..functions.variants import has_value, plain

TOLD = "array<struct<name:string,value:string>>"
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def spread(df: DataFrame) -> DataFrame:
    """An input of fewer splits than cores is dealt over the cores before it is analysed; a large one is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _analysed(df: DataFrame, analysed: Column, *keep: str) -> DataFrame:
    """With ids and tokens: words, then identifiers, one for each category. Batches are small, as a text can be long."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= ROWS:
        conf.set(BATCH, str(ROWS))
    return df.withColumn("_a", analysed).select("offense_id", "event_index", "event_id", "load_ord", *keep, "_a.ids", "_a.tokens")


def record_documents(records: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Documents of records: names and values of non-empty fields, by field name."""
    known = {n: field_name_words(n) for n in (mapping or load_mapping())}
    held = F.filter(F.map_entries("fields"), lambda e: has_value(e["value"]))

    def values(e: Column) -> Column:
        return F.array_join(F.filter(F.transform(e["value"]["items"], plain), lambda v: v.isNotNull() & (v != "")), " ")

    told = F.sort_array(F.filter(F.transform(held, lambda e: F.struct(e["key"].alias("name"), values(e).alias("value"))), lambda e: e["value"] != ""))
    rows = spread(records).select("offense_id", "event_index", "event_id", "load_ord", F.coalesce(told, F.array().cast(TOLD)).alias("told"))
    return _analysed(rows.withColumn("shown", shown(F.col("told"))), analysed_fields(F.col("told"), lambda n: known.get(n, n)), "shown")


def shown(told: Column) -> Column:
    """The fields that are displayed, in that order."""
    order = F.array(*[F.lit(n) for n in DISPLAY_FIELDS])
    placed = F.transform(told, lambda e: F.struct(F.array_position(order, e["name"]).alias("at"), e.alias("e")))
    return F.transform(F.sort_array(F.filter(placed, lambda p: p["at"] > 0)), lambda p: p["e"])


def text_documents(df: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """Documents of a table with one text for each row; a row's key is its place and its id, so nothing is sorted."""
    scope = F.col(group).cast("string") if group else F.lit("all")
    rows = df.select(scope.alias("offense_id"), F.col(key).cast("long").alias("event_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("load_ord", F.col("event_id")).withColumn("event_index", F.col("event_id"))
    return _analysed(spread(rows), analysed_text(F.col("text")))
