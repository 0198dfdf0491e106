"""Intake: an uploaded raw incident is checked, stored, extracted, validated and searched once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SMOKE_FIELDS, SPARSE_FIELDS, load_mapping
from ..functions.variants import has_value, payload, plain
from ..sources.records import SAFE_NAME, available, offense_id_of, raw_files, read_raw, scan, write_bytes, write_records
from .exact import answer
from .extract import extract
from .quality import record_checks, smallest
from .router import route

STAGES = ("error", "warning", "pass")


@dataclass
class Report:
    uploaded_filename: str | None = None
    offense_id: str | None = None
    status: str = "running"
    raw_file_path: str | None = None
    metadata_file_path: str | None = None
    event_count: int = 0
    discovered_offense_count: int = 0
    non_empty_field_min: int | None = None
    non_empty_field_avg: float | None = None
    non_empty_field_max: int | None = None
    checks: list[dict] = field(default_factory=list)
    smoke_results: list[dict] = field(default_factory=list)

    def add(self, status: str, check: str, detail: str) -> None:
        self.checks.append({"status": status, "check": check, "detail": detail})

    @property
    def failed(self) -> bool:
        return any(c["status"] == "error" for c in self.checks)

    def closed(self) -> Report:
        self.status = "failed" if self.failed else "success"
        return self


def sample(indexes: list[int], total: int) -> str:
    """The first indexes, and how many more."""
    more = total - len(indexes)
    return ", ".join(map(str, indexes)) + (f", and {more} more" if more > 0 else "")


def parse_upload(report: Report, data: bytes) -> list | None:
    """The events of an upload, with checks of encoding, JSON and shape."""
    try:
        doc = json.loads(data.decode("utf-8-sig"))
    except UnicodeDecodeError as e:
        report.add("error", "invalid JSON", f"not UTF-8 at byte {e.start}")
        return None
    except json.JSONDecodeError as e:
        report.add("error", "invalid JSON", f"line {e.lineno}, column {e.colno}: {e.msg}")
        return None
    if not isinstance(doc, dict):
        report.add("error", "json shape", "the top level must be an object with an events list")
        return None
    events = doc.get("events")
    if not isinstance(events, list) or not events:
        report.add("error", "events", "no events list" if not isinstance(events, list) else "the events list is empty")
        return None
    report.add("pass", "events", f"{len(events)} events")
    return events


def choose_target(report: Report, spark: SparkSession, name: str, raw_dir: str, records_path: str, overwrite: bool) -> str:
    """The raw file to write. What is there already is an error, or with overwrite a warning."""
    there = raw_files(spark, raw_dir).get(report.offense_id, [])
    others = [n for n in there if n != name]
    level = "warning" if overwrite else "error"
    target = name
    if name in there:
        report.add(level, "existing raw file", f"{name} exists")
    elif others and (not overwrite or len(there) > 1):
        report.add("error", "existing raw filename", f"other raw files of this incident: {', '.join(others)}")
    elif others:
        target = others[0]
        report.add("warning", "existing raw filename", f"{target} is written instead of {name}")
    if report.offense_id in available(spark, records_path):
        report.add(level, "existing metadata output", f"records of {report.offense_id} exist")
    else:
        report.add("pass", "existing metadata output", "no records yet")
    return target


def check_payload_ids(report: Report, events: DataFrame) -> None:
    """A missing, null, empty or zero id of a payload counts as missing."""
    told = F.try_variant_get(payload(F.col("event")), "$.id", "string")
    missing = told.isNull() | told.isin("", "0", "false", "0.0", "[]", "{}")
    n = events.where(missing).count()
    if n:
        report.add("warning", "missing utf8_payload.id", f"{n} events: {sample(smallest(events, missing), n)}")
    else:
        report.add("pass", "missing utf8_payload.id", "every event has one")


def validate(report: Report, records: DataFrame, expected: int) -> None:
    got = record_checks(records, report.offense_id).first()
    report.event_count = got["events"]
    report.non_empty_field_min, report.non_empty_field_avg, report.non_empty_field_max = got["non_empty_field_min"], got["non_empty_field_avg"], got["non_empty_field_max"]
    for bad, level, check, told in (
        (got["other"] > 0, "error", "metadata offense_id", f"{got['other']} records of another incident"),
        (got["events"] != expected, "error", "metadata event count", f"{got['events']} records for {expected} events"),
        (got["no_index"] + got["no_fields"] > 0, "error", "metadata identity", f"{got['no_index']} records without an index, {got['no_fields']} without fields"),
        (got["duplicates"] > 0, "error", "metadata event indexes", f"{got['duplicates']} indexes more than once"),
        (got["no_id"] > 0, "warning", "metadata event_id", f"{got['no_id']} records without an id"),
        (got["sparse"] > 0, "warning", "sparse mapped fields", f"{got['sparse']} records with fewer than {SPARSE_FIELDS} fields"),
    ):
        report.add(level if bad else "pass", check, told if bad else "ok")


def smoke(report: Report, records: DataFrame) -> None:
    """One exact question and one routed search for a value that is there."""
    found = answer(records, "source ip")
    ok = found.resolved_field == "qradar.sourceip" and found.event_count > 0
    report.smoke_results.append({"search": "exact", "query": "source ip", "method": "exact_field", "result_count": found.event_count, "ok": ok})
    report.add("pass" if ok else "warning", "search smoke exact", f"{found.resolved_field}: {found.event_count} events")
    firsts = records.agg(*[F.first(F.when(has_value(F.col("fields")[f]), plain(F.get(F.col("fields")[f]["items"], F.lit(0)))), True) for f in SMOKE_FIELDS]).first()
    query = next((v for v in firsts if v), None)
    if query is None:
        report.add("warning", "search smoke metadata", "no value to search for")
        return
    got = route(records, query)
    report.smoke_results.append({"search": "metadata", "query": query, "method": got.method, "result_count": got.result_count, "ok": got.result_count > 0})
    report.add("pass" if got.result_count else "warning", "search smoke metadata", f"{got.method}: {got.result_count} rows")


def run_intake(spark: SparkSession, filename: str | None, data: bytes | None, raw_dir: str, records_path: str, overwrite: bool = False, mapping_path: str | None = None) -> Report:
    """Take in one upload. Any error before the first write stops it; later failures are reported, not raised."""
    report = Report(filename)
    if not filename or data is None:
        report.add("error", "upload file", "nothing was selected")
        return report.closed()
    name = PurePosixPath(filename.replace("\\", "/")).name
    if name != filename:
        report.add("warning", "uploaded filename", f"path parts were removed: {name}")
    if not SAFE_NAME.match(name):
        report.add("error", "uploaded filename", "use letters, digits, _, . and -, ending in .json")
        return report.closed()
    report.offense_id = offense_id_of(name)
    if report.offense_id is None:
        report.add("error", "missing offense_id", "the name must be offense_<id>*.json")
        return report.closed()
    events = parse_upload(report, data)
    if events is None:
        return report.closed()
    target = choose_target(report, spark, name, raw_dir, records_path, overwrite)
    if report.failed:
        return report.closed()
    report.raw_file_path, report.metadata_file_path = f"{raw_dir}/{target}", f"{records_path}/offense_id={report.offense_id}"
    try:
        write_bytes(spark, report.raw_file_path, data)
        report.add("pass", "save raw offense", target)
        raw = read_raw(spark, report.raw_file_path)
        check_payload_ids(report, raw)
        write_records(extract(raw, load_mapping(mapping_path)), records_path)
        report.add("pass", "extract metadata", report.metadata_file_path)
        records = scan(spark, records_path, report.offense_id)
        validate(report, records, len(events))
        there = available(spark, records_path)
        report.discovered_offense_count = len(there)
        report.add("pass" if report.offense_id in there else "warning", "discovery refresh", f"{len(there)} incidents")
        smoke(report, records)
    except Exception as e:  # the report is the interface: whatever fails after the first write is told there
        report.add("error", "intake pipeline", f"{type(e).__name__}: {e}"[:500])
    return report.closed()
