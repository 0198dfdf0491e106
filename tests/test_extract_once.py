"""One cast by a tree of paths reads what every path reads by itself; work on records grows with their rows alone."""

import json

from pyspark.sql import functions as F

from eventlantern.config import load_mapping
from eventlantern.functions.variants import payload, plain, read_field, read_fields
from eventlantern.operators.extract import extract
from eventlantern.session import configure

ODD = {
    "leaf": ["utf8_payload.a"], "below leaf": ["utf8_payload.a.b"], "other case": ["utf8_payload.A"], "list of leaf": ["utf8_payload.a[]"], "deep": ["utf8_payload.p[].q[].r.s"], "deep end": ["utf8_payload.p[].q[]"], "in object": ["utf8_payload.o.p[].x.y"],
    "fallback": ["utf8_payload.none[].x", "utf8_payload.a", "event.sourceip"], "tick": ["utf8_payload.t`k.v"], "root": ["utf8_payload"], "short": ["e.sourceip"], "colon": ["utf8_payload.registry:set.key"],
}
VALUES = (None, "", "x", 'quo"te', "null", "[1]", "{}", 0, 1.50, 1e30, True, [], {}, [None], [1, 1, None, "a", [2], {"b": 1}], {"b": 2}, {"b": None}, {"p": [{"x": {"y": 1}}, {"x": 3}, 5, None]})


def payloads():
    for v in VALUES:
        yield {"a": v, "A": v, "o": v, "p": v, "t`k": {"v": v}, "registry:set": {"key": v}, "bp_data": v, "tactics": v, "computer": v, "file": {"file_name": v}}
        yield {"id": 1, "p": [{"q": v}, {"q": [{"r": {"s": v}}, v]}, v], "o": {"p": v}, "bp_data": {"details": {"actions": [{"name": v}, v], "matched_activity": {"events": [{"registry:set": v}, {"registry:set": {"key": v}}]}}, "observables": v}, "computer": {"network_addresses": [{"ip": v}, v]}}


def events(spark):
    texts = [json.dumps({"sourceip": k, "utf8_payload": p if k % 2 else json.dumps(p)}) for k, p in enumerate(payloads())]
    texts += ['{"utf8_payload":"  {\\"a\\":1} junk"}', '{"utf8_payload":"{\\"a\\":"}', '{"utf8_payload":"[{}]"}', '{"utf8_payload":7}', '{"utf8_payload":null}', "[]", "1"]
    rows = configure(spark).createDataFrame(list(enumerate(texts)), "event_index long, t string")
    return rows.select(F.lit("1").alias("offense_id"), "event_index", F.parse_json("t").alias("event")).withColumn("_p", payload(F.col("event")))


def test_a_walk_over_an_event_gives_what_every_path_gives(spark):
    for mapping in (load_mapping(), ODD):
        read = read_fields(F.col("event"), F.col("_p"), mapping)
        told = lambda fields: F.to_json(F.struct(*[f.alias(f"f{k}") for k, f in enumerate(fields)]), {"ignoreNullFields": "false"})
        alone = [read_field(F.col("event"), F.col("_p"), paths) for paths in mapping.values()]
        rows = events(spark).withColumn("read", read)
        for r in rows.select("event_index", told([F.col("read")[n] for n in mapping]).alias("got"), told(alone).alias("want")).collect():
            assert r["got"] == r["want"], r["event_index"]


def test_extraction_reads_an_event_once_for_all_fields(spark):
    from eventlantern.operators.extract import long_form

    spark.conf.set("spark.sql.maxToStringFields", "10000")
    for rows in (extract(events(spark).drop("_p")), long_form(extract(events(spark).drop("_p")))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert 2 <= plan.count("try_variant_get(event") + plan.count("try_variant_get(_p") < 10
    spark.conf.unset("spark.sql.maxToStringFields")


def test_text_of_values_without_and_with_escapes(spark):
    items = ['"plain"', '""', '"a\\"b"', '"\\u0041"', '"a" ', "12", "1.50", "-0", "true", "null", '{"b":1,"a":"x"}', '["x","",null,2]', None, '"a\nb"', '"']
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string").select("k", plain(F.col("x")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in rows][:7] == ["plain", "", 'a"b', "A", "a", "12", "1.5"] and [r["t"] for r in rows][8:14] == ["true", None, "b 1 a x", "x 2", None, None]


def test_shared_files_give_what_folders_give(spark, records, tmp_path):
    from eventlantern.sources.records import scan_shared, write_shared

    write_shared(records.repartition(2, "offense_id"), f"{tmp_path}/r")
    key, told = records.first()["offense_id"], lambda df: sorted((r["offense_id"], r["load_ord"], r["event_id"], str(r["fields"])) for r in df.collect())
    assert told(scan_shared(spark, f"{tmp_path}/r")) == told(records)
    assert told(scan_shared(spark, f"{tmp_path}/r", key)) == told(records.where(F.col("offense_id") == key))
    assert not [n for n in __import__("os").listdir(f"{tmp_path}/r") if n.startswith("offense_id=")]


def test_a_file_for_each_incident_is_written_by_the_tasks(spark, tmp_path):
    from eventlantern.sources.records import records_files, write_texts

    rows = spark.createDataFrame([("7", '{"a":1}'), ("a b", '{"b":"é"}')], "offense_id string, value string")
    write_texts(rows, f"{tmp_path}/j", "event_metadata_records_{}.json")
    assert list(records_files(spark, f"{tmp_path}/j")) == ["7", "a b"] and (tmp_path / "j/event_metadata_records_a b.json").read_text().strip() == '{"b":"é"}'


def test_a_search_does_not_analyse_stored_documents_again(spark, tiny):
    from eventlantern.plans.incidents import _documents

    assert "regexp_extract_all" not in _documents(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_records_are_made_without_storing_the_records(spark, tiny, tmp_path):
    from eventlantern.plans import incidents

    (tmp_path / "events.parquet").symlink_to(f"{tiny}/events.parquet")
    docs = incidents._documents(spark, str(tmp_path))
    assert (spark.sparkContext.applicationId, str(tmp_path)) not in incidents._stored
    stored = incidents.record_documents(incidents.stored_records(spark, str(tmp_path)))
    assert not docs.exceptAll(stored).count() and not stored.exceptAll(docs).count()
