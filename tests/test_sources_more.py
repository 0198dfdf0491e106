"""Records files, odd ids, streams with several files of one incident, times in lists, what a page shows."""

import json
import os
import time

import incidents as made
import pytest
from pyspark.sql import functions as F

from eventlantern.functions.variants import plain
from eventlantern.operators.display import clamped, envelope, route_rows
from eventlantern.operators.extract import extract
from eventlantern.operators.intake import run_intake
from eventlantern.operators.inventory import event_time
from eventlantern.sources.records import available, load_records, read_records_json, records_files, relative, scan, write_bytes, write_records
from eventlantern.streaming.intake import stream_intake


def test_json_records_files(spark, tmp_path):
    doc = {"offense_id": "", "events": [{"event_identity": {"event_index": 4, "event_id": 9}, "fields": {"a.b": "x", "list": [1, "y", None], "none": None, "empty": ""}}, {"event_identity": {"offense_id": "other"}, "fields": {}}]}
    write_bytes(spark, f"{tmp_path}/event_metadata_records_77.json", json.dumps(doc).encode())
    got = load_records(spark, f"{tmp_path}/event_metadata_records_77.json").orderBy("load_ord").collect()
    assert [(r.offense_id, r.event_index, r.event_id, r.load_ord) for r in got] == [("77", 4, 9, 0), ("other", 1, None, 1)]
    assert got[0].fields["a.b"]["items"] == ['"x"'] and got[0].fields["list"]["items"][:2] == ["1", '"y"'] and got[0].fields["none"] is None
    assert list(records_files(spark, str(tmp_path))) == ["77"] and load_records(spark, str(tmp_path), "77").count() == 2
    with pytest.raises(FileNotFoundError):
        load_records(spark, str(tmp_path), "78")
    write_bytes(spark, f"{tmp_path}/event_metadata_records_78.json", b'{"offense_id": "78"}')
    with pytest.raises(ValueError):
        read_records_json(spark, f"{tmp_path}/event_metadata_records_78.json")
    assert relative(f"{tmp_path}/a/b", str(tmp_path)) == "a/b" and relative("/elsewhere/x", str(tmp_path)) == "/elsewhere/x"


def test_ids_that_a_folder_name_has_to_escape(spark, tmp_path):
    one = spark.createDataFrame([("a=b%c/d",)], "offense_id string").select("offense_id", F.lit(0).cast("long").alias("event_index"), F.parse_json(F.lit('{"utf8_payload":{"id":1}}')).alias("event"))
    write_records(extract(one), f"{tmp_path}/r")
    assert available(spark, f"{tmp_path}/r") == ["a=b%c/d"] and scan(spark, f"{tmp_path}/r", "a=b%c/d").count() == 1


def test_of_two_files_in_one_batch_the_last_counts(spark, tmp_path):
    for name, n, at in (("offense_9_b.json", 3, 1000), ("offense_9_a.json", 2, 2000), ("offense_8.json", 1, 1500)):
        os.makedirs(f"{tmp_path}/raw", exist_ok=True)
        with open(f"{tmp_path}/raw/{name}", "wb") as f:
            f.write(made.raw([made.event({"id": k}) for k in range(n)]))
        os.utime(f"{tmp_path}/raw/{name}", (time.time() - 5000 + at,) * 2)
    stream_intake(spark, f"{tmp_path}/raw", f"{tmp_path}/records", f"{tmp_path}/checkpoint", {"id": ["utf8_payload.id"]}).awaitTermination()
    assert sorted((r.offense_id, r.event_index) for r in scan(spark, f"{tmp_path}/records").collect()) == [("8", 0), ("9", 0), ("9", 1)]


def test_the_first_time_in_a_list_counts(spark):
    held = lambda *xs: (False, [json.dumps(x) for x in xs])
    rows = [({"a": held("junk", "1700000000"), "b": held("1600000000")},), ({"a": None, "b": held("x", "2026-01-02")},), ({"a": held(), "b": None},)]
    df = spark.createDataFrame(rows, "fields map<string,struct<scalar:boolean,items:array<string>>>")
    got = [r[0] for r in df.select(event_time("a", "b").cast("string")).collect()]
    assert got == ["2023-11-14 22:13:20", "2026-01-02 00:00:00", None]


def test_nested_values_keep_their_own_marks(spark):
    texts = ['{"url":"http://a.b:80/x","n":[1,{"k":"z, {y}"}]}', '["a \\"b\\"", null, ""]', '"plain"', "1.5", "true", "{}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(plain(F.col("t"))).collect()]
    assert got == ["url http://a.b:80/x n 1 k z, {y}", 'a "b"', "plain", "1.5", "true", ""]


def test_a_raw_file_can_be_replaced_under_its_own_name(spark, tmp_path):
    data = made.raw([made.event({"id": 1})])
    for name in ("offense_3_a.json", "offense_3_b.json"):
        write_bytes(spark, f"{tmp_path}/raw/{name}", data)
    got = run_intake(spark, "offense_3_a.json", data, f"{tmp_path}/raw", f"{tmp_path}/records", overwrite=True)
    assert got.status == "success" and ("warning", "existing raw file") in {(c["status"], c["check"]) for c in got.checks}
    refused = run_intake(spark, "offense_3_c.json", data, f"{tmp_path}/raw", f"{tmp_path}/records", overwrite=True)
    assert refused.status == "failed"


def test_what_a_page_shows():
    assert [clamped(n) for n in (-3, 0, 5, 99)] == [1, 1, 5, 10]
    assert envelope("192.0.2.1", "bm25", []) == {"query": "192.0.2.1", "method": "bm25", "query_type": "identifier_like", "query_identifiers": {"ip": ["192.0.2.1"]}, "results": []}
    assert route_rows([{"method": "bm25"}]) == [{"step": 1, "method": "bm25"}]
