"""Exact answers: the values of the field that a question names, and the events that have one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RESOLVE_THRESHOLD, RESOLVE_TOP
from ..functions.variants import has_value, plain
from .resolve import resolve_one


@dataclass
class Answer:
    """`values` (value) and `events` (offense_id, event_index) are DataFrames in order; event_count is their number of events."""

    question: str
    resolved_field: str | None = None
    resolved_fields: list[str] = field(default_factory=list)
    event_count: int = 0
    values: DataFrame | None = None
    events: DataFrame | None = None


def _held(name: str):
    return F.col("fields")[name]


def field_values(records: DataFrame, fields: list[str]) -> DataFrame:
    """(value, first_field, offense_id, load_ord, pos): every distinct JSON value of the fields at its first place."""
    parts = [records.select(F.lit(k).alias("k"), "offense_id", "load_ord", F.posexplode(F.when(has_value(_held(f)), _held(f)["items"])).alias("pos", "item")) for k, f in enumerate(fields)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = F.min(F.struct("k", "offense_id", "load_ord", "pos")).alias("at")
    return rows.where("item is not null and item not in ('null', '\"\"')").groupBy("item").agg(first).orderBy("at").select("item", plain(F.col("item")).alias("value"))


def field_events(records: DataFrame, fields: list[str]) -> DataFrame:
    """(offense_id, event_index) of events with a value in any of the fields, in load order."""
    test = has_value(_held(fields[0]))
    for f in fields[1:]:
        test = test | has_value(_held(f))
    return records.where(test).groupBy("offense_id", "event_index").agg(F.min("load_ord").alias("load_ord")).orderBy("offense_id", "load_ord").select("offense_id", "event_index")


def answer(records: DataFrame, question: str, aliases: dict | None = None, top: int = RESOLVE_TOP, threshold: float = RESOLVE_THRESHOLD) -> Answer:
    """All candidate fields are counted in one pass. Those without a value fall through; ties merge."""
    if not question.strip():
        return Answer(question)
    found = resolve_one(records.sparkSession, question, aliases, top, threshold)
    if not found:
        return Answer(question)
    counts = records.agg(*[F.count_if(has_value(_held(c["field"]))) for c in found]).first()
    full = [c for c, n in zip(found, counts, strict=True) if n]
    if not full:
        return Answer(question, found[0]["field"], [found[0]["field"]])
    best = full[0]
    fields = [c["field"] for c in full if (c["score"], c["matched_alias"]) == (best["score"], best["matched_alias"])]
    events = field_events(records, fields)
    return Answer(question, ", ".join(fields), fields, events.count(), field_values(records, fields), events)


def matching_rows(records: DataFrame, found: Answer) -> DataFrame:
    """The events of an answer: the resolved values as text, and all fields."""
    shown = F.array_join(F.flatten(F.array(*[F.coalesce(F.transform(_held(f)["items"], plain), F.array().cast("array<string>")) for f in found.resolved_fields])), ", ")
    display = F.transform_values("fields", lambda _, v: F.when(v["scalar"], plain(F.get(v["items"], F.lit(0)))).otherwise(F.concat(F.lit("["), F.array_join(v["items"], ", "), F.lit("]"))))
    # Cut to what is shown before the join, which else would move every record whole.
    rows = records.select("offense_id", "event_index", "event_id", shown.alias("value"), display.alias("fields"))
    return rows.join(found.events, ["offense_id", "event_index"], "left_semi").orderBy("offense_id", "event_index")
