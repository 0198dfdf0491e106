import incidents as made
import pytest
from pyspark.sql import functions as F

from eventlantern.functions.identifiers import CATEGORIES, identifiers, identifiers_of
from eventlantern.functions.scoring import fuzzy_match
from eventlantern.functions.text import field_name_words, normalize_text, words_of
from eventlantern.operators.documents import record_documents
from eventlantern.operators.exact import answer, matching_rows
from eventlantern.operators.resolve import resolve_one
from eventlantern.operators.router import route, text_route
from eventlantern.operators.search import analyse, bm25, fuzzy, search


@pytest.fixture(scope="module")
def docs(records):
    return record_documents(records).persist()


def scope(docs, key):
    return docs.where(F.col("offense_id") == key)


def test_text_rules():
    assert normalize_text("  Source_IP-Address.x É9 ") == "source ip address x 9"
    assert words_of("What is the setup.exe path?") == ["setup", "path"]
    assert field_name_words("qradar.sourceip") == "qradar.sourceip qradar sourceip qradar source ip"


TEXTS = [
    "10.1.2.3 and 1.2 and 1.2.3.4.5 v10.2", "é10.1.1.1 ü", "hash " + "a" * 32 + " " + "b" * 65, "123e4567-e89b-12d3-a456-426614174000",
    "run quiet-tool9.exe now, SETUP.EXE!", "key HKLM/Software/Demo Value here", "\\Machine\\Software\\\\X", "see the hostname. and host.example.test.",
    "AA-STEMX-1000.DOMAIN, BB-77 srv-01-x", "2026-01-02T03:04:05", "a.b-1- x_a-1.com -q.r5-2 10.0.0.0/8 w32.demo.ioc", "", "cmd.exe.local a1-b2.c3-d4 zz-9", None,
]


def test_identifier_columns_agree_with_the_driver(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    for r in df.select("t", identifiers(F.col("t")).alias("i")).collect():
        want = identifiers_of(r["t"] or "")
        assert {c: sorted(r["i"][c]) for c in CATEGORIES if r["i"][c]} == {c: sorted(v) for c, v in want.items()}, r["t"]


def test_identifier_quirks():
    assert identifiers_of("is it the hostname.") == {"hostname": ["hostname"]}
    assert set(identifiers_of("123e4567-e89b-12d3-a456-426614174000")) == {"uuid", "hostname"}
    assert identifiers_of("run quiet-tool9.exe") == {"file_name": ["quiet-tool9.exe"], "hostname": ["quiet-tool9"]}
    assert identifiers_of("at 2026-01-02T03:04") == {"hostname": ["2026-01-02t03"]}


@pytest.mark.parametrize(("a", "b", "want"), [
    ("setup", "setup", (1.0, "exact")), ("setup", "setupplatform", (5 / 13, "partial")), ("abc", "abcd", (0.0, None)), ("typo", "type", (0.0, None)),
    ("platform", "platfrom", (0.75, "fuzzy")), ("abcdefghi", "abcdefxyi", (1 - 2 / 9, "fuzzy")), ("abcdef", "abxyef", (0.0, None)), ("short", "muchlongerword", (0.0, None)),
])
def test_fuzzy_match(spark, a, b, want):
    got = spark.range(1).select(fuzzy_match(F.lit(a), F.lit(b)).alias("m")).first()["m"]
    assert got["kind"] == want[1] and abs(got["score"] - want[0]) < 1e-12


def test_bm25_finds_detection_process_and_registry(docs):
    one = scope(docs, "101")
    for q in ("Registry Autostart Entry Modified", "sampleplatform.exe", "winlogon userinit"):
        rows = bm25(one, q).collect()
        assert rows and rows[0]["matched_terms"] and rows[0]["score"] > 0
        assert [(-r["score"], r["event_index"]) for r in rows] == sorted((-r["score"], r["event_index"]) for r in rows)
    assert "sampleplatform.exe" in bm25(one, "sampleplatform.exe").first()["matched_identifiers"]


def test_limit_and_default(docs):
    four = scope(docs, "104")
    assert len(bm25(four, "Threat Quarantined Failed Demo").collect()) == 10
    assert len(bm25(four, "Threat Quarantined", limit=3).collect()) == 3 and bm25(four, "Threat", limit=0).collect() == []
    with pytest.raises(ValueError):
        bm25(four, "Threat", limit=-1)
    with pytest.raises(ValueError):
        search(four, "x", mode="other")


def test_identifier_queries_are_gated(docs):
    one = scope(docs, "101")
    assert [r["event_index"] for r in bm25(one, "10.1.0.3").collect()] == [3]
    assert bm25(one, "10.1.0.77").collect() == [] and fuzzy(one, "10.1.0.77").collect() == []
    assert [r["event_index"] for r in bm25(one, "AA-STEMX-1002.DOMAIN").collect()] == [2]
    assert [r["event_index"] for r in bm25(one, "AA-STEMX-1002").collect()] == [2]


def test_host_typos_keep_numbers(docs):
    one = scope(docs, "101")
    assert [r["event_index"] for r in fuzzy(one, "AA-STEMXX-1003.DOMAIN").collect()] == [3]
    assert fuzzy(one, "AA-STEMX-1900.DOMAIN").collect() == []


def test_file_typo_is_fuzzy(docs):
    row = fuzzy(scope(docs, "101"), "sampelplatform.exe").first()
    assert row["matched_terms"][0]["match_type"] == "fuzzy" and row["matched_identifiers"] == ["sampleplatform.exe"]
    assert analyse("sampelplatform.exe").kind == "identifier_like"


def test_free_text_partial_and_weak_typo(docs):
    one = scope(docs, "101")
    row = fuzzy(one, "sample").first()
    assert ("sampleplatform", "partial") in {(m["matched_term"], m["match_type"]) for m in row["matched_terms"]}
    assert fuzzy(one, "dmoo").collect() == []
    assert fuzzy(one, "the of").collect() == [] and bm25(one, "").collect() == []


def test_scopes_do_not_leak(docs):
    assert {r["offense_id"] for r in bm25(docs, "cmd.exe").collect()} == {"103"}
    assert bm25(scope(docs, "101"), "cmd.exe").collect() == []
    top = bm25(scope(docs, "102"), "hidden account").first()
    assert top["event_index"] == 0 and ("registry_set.value", "hidden-account") in [tuple(f) for f in top["shown"]]
    assert top["shown"][0]["name"] == "cisco.detection"


def test_hash_in_any_case(docs):
    assert len(bm25(docs, made.sha("cmd")).collect()) == 2
    assert len(bm25(docs, made.sha("cmd").upper()).collect()) == 2


def test_resolver_reasons(spark):
    aliases = {"a.ip": ["source ip"], "b.x": ["command line"], "c.x": ["command line"], "d.user": ["user name of the process"]}
    assert resolve_one(spark, "source ip", aliases)[0] | {"rank": 1} == {"question_id": 0, "rank": 1, "field": "a.ip", "score": 1.0, "matched_alias": "source ip", "reason": "exact_question_match", "phrase_words": 2, "question_words": 2}
    top = resolve_one(spark, "Show me the source ip of it", aliases)[0]
    assert (top["score"], top["reason"]) == (0.92, "alias_phrase_in_question")
    assert [r["field"] for r in resolve_one(spark, "command line", aliases)[:2]] == ["b.x", "c.x"]
    assert resolve_one(spark, "user name", aliases)[0]["reason"] == "question_phrase_in_alias"
    assert resolve_one(spark, "zebra", aliases) == []


def test_exact_answers(records):
    got = answer(records.where("offense_id = '101'"), "What is the source ip?")
    assert got.resolved_field == "qradar.sourceip" and got.event_count == 10
    assert [r["value"] for r in got.values.collect()] == [f"192.0.2.{10 + k}" for k in range(10)]
    assert [r["event_index"] for r in got.events.collect()] == list(range(10))
    assert matching_rows(records, got).count() == 10
    two = answer(records.where("offense_id = '102'"), "command line", {"actions.cmd_line": ["command line"], "registry_set.cmd_line": ["command line"]})
    assert two.resolved_fields == ["registry_set.cmd_line"], "a field without values falls through"
    both = answer(records.where("offense_id in ('102', '103')"), "command line", {"actions.cmd_line": ["command line"], "registry_set.cmd_line": ["command line"]})
    assert both.resolved_fields == ["actions.cmd_line", "registry_set.cmd_line"] and both.event_count == 4, "ties merge"
    assert answer(records, " ").resolved_field is None
    none = answer(records.where("offense_id = '105'"), "registry value", {"registry_set.value": ["registry value"]})
    assert none.event_count == 0 and none.resolved_field == "registry_set.value"


def test_routes(records):
    one = records.where("offense_id = '101'")
    exact = route(one, "What is the source ip?")
    assert (exact.method, exact.result_count, exact.route[0]["reason"]) == ("exact_field", 10, "resolver_candidate_confident")
    text = route(one, "sampleplatform.exe")
    assert text.method == "bm25" and [s["reason"] for s in text.route] == ["identifier_query_skips_exact_field", "exact_identifier_match"]
    near = route(one, "sample", mode="metadata-text")
    assert near.method == "fuzzy" and near.route[-1]["reason"] == "fallback_after_bm25_weak_or_empty" and near.route[0]["reason"] == "no_bm25_results"
    assert route(one, "source ip", mode="exact").method == "exact_field"
    assert route(one, "  ").result_count == 0
    with pytest.raises(ValueError):
        route(one, "x", mode="vector")


def test_text_route_over_documents(docs):
    got = text_route(scope(docs, "102"), "hidden account")
    assert got.method == "bm25" and got.result_count == 2 and got.result[0]["event_index"] == 0
