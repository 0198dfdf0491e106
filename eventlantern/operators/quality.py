"""Checks of records: density, duplicates, missing ids, coverage of configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SPARSE_FIELDS
from ..functions.variants import has_value


def density(records: DataFrame) -> DataFrame:
    """records with non_empty: how many of its fields hold a value."""
    return records.withColumn("non_empty", F.size(F.filter(F.map_values("fields"), has_value)))


def record_checks(records: DataFrame, offense_id: str) -> DataFrame:
    """One row with every count that the checks of an intake need, in one pass and one small aggregation.

    duplicate indexes are counted from an aggregation by index, so no list of rows is gathered.
    """
    rows = density(records)
    by_index = rows.groupBy("event_index").agg(
        F.count("*").alias("n"), F.min("non_empty").alias("low"), F.max("non_empty").alias("high"), F.sum("non_empty").alias("total"),
        F.count_if(F.col("non_empty") < SPARSE_FIELDS).alias("sparse"), F.count_if(F.col("event_id").isNull()).alias("no_id"), F.count_if(~F.col("offense_id").eqNullSafe(offense_id)).alias("other"), F.count_if(F.col("fields").isNull()).alias("no_fields"),
    )
    return by_index.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.min("low").alias("non_empty_field_min"), F.bround(F.sum("total") / F.sum("n"), 2).alias("non_empty_field_avg"), F.max("high").alias("non_empty_field_max"),
        F.coalesce(F.sum("sparse"), F.lit(0)).alias("sparse"), F.coalesce(F.sum("no_id"), F.lit(0)).alias("no_id"), F.coalesce(F.sum("other"), F.lit(0)).alias("other"),
        F.coalesce(F.sum("no_fields"), F.lit(0)).alias("no_fields"),
        F.count_if(F.col("event_index").isNull()).alias("no_index"), F.count_if(F.col("n") > 1).alias("duplicates"),
    )


def smallest(rows: DataFrame, test, n: int = 5) -> list[int]:
    """The n smallest event_index that pass a test."""
    return [r[0] for r in rows.where(test).select("event_index").orderBy("event_index").limit(n).collect()]


def coverage(mapping: dict, aliases: dict, descriptions: dict) -> dict[str, list[str]]:
    """Names that break: mapping fields = alias fields, and both within the descriptions."""
    return {
        "without_alias": sorted(set(mapping) - set(aliases)),
        "without_mapping": sorted(set(aliases) - set(mapping)),
        "without_description": sorted(set(mapping) - set(descriptions)),
    }


def raw_matches(raw: DataFrame, records: DataFrame) -> DataFrame:
    """(offense_id, raw_files, has_records, ok) of raw(offense_id), a row for each raw file, and records(offense_id).

    ok: exactly one raw file. Two raw files are a duplicate, records without one have no source.
    """
    files = raw.groupBy("offense_id").agg(F.count("*").alias("raw_files"))
    held = records.select("offense_id").distinct().withColumn("has_records", F.lit(True))
    both = files.join(held, "offense_id", "full").select("offense_id", F.coalesce("raw_files", F.lit(0)).alias("raw_files"), F.coalesce("has_records", F.lit(False)).alias("has_records"))
    return both.withColumn("ok", F.col("raw_files") == 1)
