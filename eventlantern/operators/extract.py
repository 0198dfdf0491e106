"""Extraction: raw events to records through a declarative mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import load_mapping
from ..functions.variants import has_value, payload, plain, read_fields


def extract(events: DataFrame, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """Records of events(offense_id, event_index, event VARIANT).

    One projection: the mapping is compiled to expressions when the plan is built. event_id is the
    payload's id. Missing and malformed payloads give empty fields, never an error.
    """
    mapping = mapping or load_mapping()
    rows = events.select("offense_id", "event_index", "event", payload(F.col("event")).alias("_p"))
    fields = read_fields(F.col("event"), F.col("_p"), mapping)
    return rows.select("event_index", F.try_variant_get("_p", "$.id", "bigint").alias("event_id"), F.col("event_index").alias("load_ord"), fields.alias("fields"), "offense_id")


def long_form(records: DataFrame) -> DataFrame:
    """(offense_id, event_index, load_ord, field, pos, value): a row for each value of each field."""
    held = F.filter(F.map_entries("fields"), lambda e: has_value(e["value"]))
    told = F.transform(held, lambda e: F.transform(e["value"]["items"], lambda item, k: F.struct(e["key"].alias("field"), k.alias("pos"), plain(item).alias("value"))))
    # In one generator: a filter above it would be pushed below and repeat the extraction.
    return records.select("offense_id", "event_index", "load_ord", F.inline(F.filter(F.flatten(told), lambda x: x["value"].isNotNull() & (x["value"] != ""))))
