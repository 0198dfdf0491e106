import json

import incidents as made

from eventlantern.operators.intake import run_intake, sample
from eventlantern.sources.records import available, scan
from eventlantern.streaming.intake import stream_intake


def names(report, status):
    return [c["check"] for c in report.checks if c["status"] == status]


def test_intake_succeeds_and_guards_what_is_there(spark, tmp_path):
    raw, rec = f"{tmp_path}/raw", f"{tmp_path}/rec"
    data = made.raw(made.INCIDENTS["101"])
    first = run_intake(spark, "offense_101_a.json", data, raw, rec)
    assert first.status == "success" and first.event_count == 10 and first.discovered_offense_count == 1, first.checks
    assert all(r["ok"] for r in first.smoke_results) and not names(first, "error")
    again = run_intake(spark, "offense_101_a.json", data, raw, rec)
    assert again.status == "failed" and names(again, "error") == ["existing raw file", "existing metadata output"]
    other = run_intake(spark, "offense_101_b.json", data, raw, rec)
    assert "existing raw filename" in names(other, "error")
    forced = run_intake(spark, "offense_101_b.json", data, raw, rec, overwrite=True)
    assert forced.status == "success" and forced.raw_file_path.endswith("offense_101_a.json")


def test_intake_rejects_bad_uploads(spark, tmp_path):
    raw, rec = f"{tmp_path}/raw", f"{tmp_path}/rec"
    for name, data, check in [
        (None, None, "upload file"), ("offense_1 x.json", b"{}", "uploaded filename"), ("events.json", b"{}", "missing offense_id"), ("offense_1.json", b"{", "invalid JSON"),
        ("offense_1.json", b"\xff\xfe", "invalid JSON"), ("offense_1.json", b"[]", "json shape"), ("offense_1.json", b"{}", "events"), ("offense_1.json", b'{"events": []}', "events"),
    ]:
        got = run_intake(spark, name, data, raw, rec)
        assert got.status == "failed" and names(got, "error") == [check], (name, got.checks)
    assert available(spark, rec) == []


def test_intake_warns(spark, tmp_path):
    got = run_intake(spark, "../offense_105_x.json", made.raw(made.INCIDENTS["105"]), f"{tmp_path}/raw", f"{tmp_path}/rec")
    assert got.status == "success", got.checks
    assert {"uploaded filename", "missing utf8_payload.id", "metadata event_id", "sparse mapped fields"} <= set(names(got, "warning"))
    told = next(c["detail"] for c in got.checks if c["check"] == "missing utf8_payload.id")
    assert told == "5 events: 0, 1, 2, 3, 4"
    assert sample([0, 1, 2, 3, 4], 9) == "0, 1, 2, 3, 4, and 4 more"


def test_stream_intake(spark, tmp_path):
    raw, rec = tmp_path / "raw", f"{tmp_path}/rec"
    raw.mkdir()
    (raw / "offense_7_x.json").write_bytes(made.raw(made.INCIDENTS["102"]))
    (raw / "bad.json").write_text(json.dumps({"events": [1]}))
    for _ in range(2):
        stream_intake(spark, str(raw), rec, f"{tmp_path}/check").awaitTermination()
    assert available(spark, rec) == ["7"] and scan(spark, rec, "7").count() == 2
