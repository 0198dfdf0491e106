import json

import incidents as made
import pytest
from pyspark.sql import functions as F

from eventlantern import config
from eventlantern.functions.times import format_time, parse_time
from eventlantern.operators.extract import extract, long_form
from eventlantern.operators.inventory import inventory
from eventlantern.operators.quality import coverage, density
from eventlantern.sources.records import available, combine, export_json, offense_id_of, raw_files, records_id_of, scan


def fields(records, offense, index=0):
    r = records.where((F.col("offense_id") == offense) & (F.col("event_index") == index)).first()
    return r["event_id"], {k: None if v is None else (json.loads(v["items"][0]) if v["scalar"] else [json.loads(x) for x in v["items"]]) for k, v in r["fields"].items()}


def test_mapping_has_every_field_once():
    assert len(config.FIELDS) == 72
    assert coverage(config.load_mapping(), config.load_aliases(), config.load_descriptions(None)) == {"without_alias": [], "without_mapping": [], "without_description": []}


def test_extraction_follows_paths_and_arrays(records):
    event_id, got = fields(records, "101", 3)
    assert event_id == 7600000000000000004
    assert got["qradar.sourceip"] == "192.0.2.13" and got["qradar.starttime"] == 1767225780000
    assert got["cisco.group_guids"] == ["g-1", "g-2"], "nulls go, the first of equals stays"
    assert got["computer.network_ips"] == ["10.1.0.3"]
    assert got["registry_set.app.name"] == ["sampleplatform.exe"] and got["registry_set.app.size"] == [103]
    assert got["actions.name"] == [] and got["qradar.username"] is None


def test_fallback_paths_give_lists_or_scalars(records):
    assert fields(records, "104")[1]["actions.name"] == "dropper-tool.exe"
    got = fields(records, "103")[1]
    assert got["cisco.detection"] == "W32.Demo.ioc" and got["actions.cmd_line"] == "cmd.exe /c echo demo"


def test_malformed_payloads_give_empty_fields(records):
    for k in range(4):
        event_id, got = fields(records, "105", k)
        assert event_id is None and got["cisco.severity"] is None and got["cisco.tactics"] == [] and got["qradar.category"] == 20
    assert fields(records, "105", 5)[1]["cisco.severity"] == "b", "of duplicate keys the last counts"
    assert fields(records, "105", 6)[1]["cisco.event_type_id"] == 0


def test_payload_may_be_an_object(spark):
    doc = made.event(None) | {"utf8_payload": {"id": 3, "severity": "Low", "extra": {"b": 1}}}
    rows = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.lit("1").alias("offense_id"), F.lit(0).alias("event_index"), F.parse_json("j").alias("event"))
    got = extract(rows, {"severity": ["p.severity"], "whole": ["p.extra"]}).first()
    assert got["event_id"] == 3 and got["fields"]["severity"]["items"] == ['"Low"'] and got["fields"]["whole"]["items"] == ['{"b":1}']


def test_scans_and_names(spark, incidents, tmp_path):
    assert available(spark, incidents[1]) == sorted(made.INCIDENTS)
    assert scan(spark, incidents[1], "103").count() == 2
    assert scan(spark, incidents[1]).count() == sum(map(len, made.INCIDENTS.values()))
    with pytest.raises(FileNotFoundError):
        scan(spark, incidents[1], "999")
    with pytest.raises(FileNotFoundError):
        scan(spark, str(tmp_path))
    assert offense_id_of("offense_12_a.json") == "12" and offense_id_of("other.json") is None
    assert records_id_of("event_metadata_records_12.json") == "12" and records_id_of("x.json") is None
    assert raw_files(spark, incidents[0])["101"] == ["offense_101_x.json"]
    one, two = scan(spark, incidents[1], "102"), scan(spark, incidents[1], "103")
    assert combine(one, two).select("offense_id").distinct().count() == 2
    export_json(one, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_pruning_reads_one_partition(spark, incidents):
    plan = scan(spark, incidents[1], "103")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(offense_id" in plan


def test_long_form_and_density(records):
    rows = long_form(records.where("offense_id = '105' and event_index = 6"))
    assert {r["field"]: r["value"] for r in rows.collect()}["cisco.event_type_id"] == "0"
    assert "cisco.severity" not in {r["field"] for r in rows.collect()}
    assert density(records).where("offense_id = '105' and event_index = 0").first()["non_empty"] == 7


@pytest.mark.parametrize(("text", "want"), [
    ("1767225600", "2026-01-01T00:00:00+00:00"), ("1767225600123", "2026-01-01T00:00:00.123+00:00"), ("1767225600123999", "2026-01-01T00:00:00.123+00:00"),
    ("1767225600123999888", "2026-01-01T00:00:00.123+00:00"), ("2026-01-01T02:00:00+02:00", "2026-01-01T00:00:00+00:00"), ("2026-01-01T00:00:00Z", "2026-01-01T00:00:00+00:00"),
    ("2026-01-01T00:00:00", "2026-01-01T00:00:00+00:00"), ("", "Unknown"), ("soon", "Unknown"), (None, "Unknown"),
])
def test_times(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(format_time(parse_time(F.col("t"))))
    assert df.first()[0] == want


def test_inventory(spark, incidents):
    rows = {r["offense_id"]: r for r in inventory(spark, incidents[1], incidents[0]).collect()}
    one = rows["101"]
    assert (one["number_of_events"], one["first_event_time"], one["last_event_time"], one["logsourceid"]) == (10, "2026-01-01T00:00:00+00:00", "2026-01-01T00:09:00+00:00", "7")
    assert one["raw_offense_file_path"].endswith("offense_101_x.json")
