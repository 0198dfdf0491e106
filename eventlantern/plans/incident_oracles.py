"""DuckDB SQL of the queries over nested incidents: every field as its own expression, without the mapping."""

from __future__ import annotations

from ..config import DISPLAY_FIELDS, SPARSE_FIELDS
from ..functions.text import field_name_words
from ..operators.search import analyse
from .incidents import FILE_SEARCH, HOST_SEARCH, IP_SEARCH, ROUTES, TEXT_SEARCH
from .oracles import ALL, ORACLES as PLAIN, TERM, docs, fuzzy_terms_cte, ids, iso, lit, strings, words

UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"
# Field, values, and where it is filled. In order of names, as search documents have it.
FIELDS = (
    ("actions.name", "['tool' || (k % 5) || '.exe']", "ok"),
    ("actions.sha256", "[sha256(event_type || '-' || k)]", "ok"),
    ("cisco.connector_guid", f"[{UUID}]", "ok AND k % 4 <> 1"),
    ("cisco.detection", "['Registry Autostart ' || event_type]", "ok"),
    ("cisco.severity", "['High']", "ok AND k % 3 <> 0"),
    ("cisco.tactics", "['TA0' || (k % 4), 'T' || (k % 7)]", "ok"),
    ("computer.hostname", "['WS-' || (u % 50) || '.corp.example.org']", "ok"),
    ("computer.network_ips", "['10.0.' || (u % 200) || '.' || (k % 250), '10.1.' || (u % 200) || '.' || (k % 250)]", "ok"),
    ("observables.file.name", "['drop' || (k % 6) || '.dll']", "ok"),
    ("qradar.logsourceid", "[(u % 5)::VARCHAR]", "true"),
    ("qradar.sourceip", "['192.0.2.' || (u % 250)]", "true"),
    ("qradar.starttime", "[(epoch_us(ts) // 1000)::VARCHAR]", "true"),
    ("registry_set.key", "['\\MACHINE\\SOFTWARE\\Demo\\Run' || (k % 3)]", "ok"),
    ("registry_set.value", "['v' || (k % 9)]", "ok"),
)
_FS = ", ".join(f"{{'f': '{n}', 'words': {lit(field_name_words(n))}, 'v': CASE WHEN {test} THEN {v} END}}" for n, v, test in FIELDS)
EVENTS = "e AS (SELECT *, user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(user_id AS VARCHAR) AS offense_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_index, event_id % 10 <> 7 AS ok, md5('u' || json_extract_string(props, '$.k')) AS m FROM events)"
RECORDS = f"{EVENTS}, f AS (SELECT offense_id, u, event_index, CASE WHEN ok AND event_id % 10 <> 3 THEN event_id END AS event_id, list_filter([{_FS}], lambda x: x.v IS NOT NULL) AS fs FROM e)"
LONG = f"WITH {RECORDS}, x AS (SELECT offense_id, event_index, unnest(fs) AS x FROM f) SELECT offense_id, event_index, x.f AS field, unnest(range(len(x.v))) AS pos, unnest(x.v) AS value FROM x"
_TEXTS = f"""{RECORDS}, told AS (SELECT offense_id, event_index, event_id, len(list_filter(fs, lambda x: list_contains({strings(DISPLAY_FIELDS)}, x.f))) AS shown,
 array_to_string(list_transform(fs, lambda x: x.words || ' ' || array_to_string(x.v, ' ')), ' ') AS all_words, array_to_string(list_transform(fs, lambda x: array_to_string(x.v, ' ')), ' ') AS value_text FROM f)"""
DOCS = f"{_TEXTS}, {ids('told', 'event_id', 'value_text')}, docs AS (SELECT *, offense_id || '/' || event_index AS doc_id, list_concat({words('all_words')}, {ALL}) AS tokens, {ALL} AS vals FROM ids)"


def ranked(query: str, limit: int, least: float, gate: str, matched: str) -> str:
    q = analyse(query)
    told = [t for t in q.tokens if not q.weak(t)]
    return f"""WITH {DOCS}, s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs), q AS (SELECT unnest({strings(q.tokens)}) AS term, unnest(range({len(q.tokens)})) AS k),
t AS (SELECT doc_id, len(tokens) AS len, term, q.k, len(list_filter(tokens, lambda x: x = term)) AS tf FROM docs, q), d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM t GROUP BY term),
r AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN {TERM} ELSE 0 END) AS raw, coalesce(string_agg(term || '>' || term || '>exact', ',' ORDER BY k) FILTER (tf > 0 AND list_contains({strings(told)}, term)), '') AS matched_terms FROM t JOIN d USING (term), s GROUP BY doc_id)
SELECT offense_id, event_index, event_id, round_even(raw, 4) AS score, matched_terms, {matched} AS matched_identifiers FROM r JOIN docs USING (doc_id) WHERE raw > {least} AND {gate} ORDER BY score DESC, event_index, offense_id LIMIT {limit}"""


def file_hits(limit: int) -> str:
    """Files within a few edits of the one asked for, every one that a record names."""
    a = len(FILE_SEARCH)
    return f"""WITH {DOCS}, s AS (SELECT count(*) AS n FROM docs), v AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term), p AS (SELECT doc_id, unnest(list_distinct(file_name)) AS term FROM docs),
m AS (SELECT doc_id, term, df, levenshtein({lit(FILE_SEARCH)}, term) AS e, 1 - levenshtein({lit(FILE_SEARCH)}, term) / greatest(length(term), {a})::DOUBLE AS score FROM p JOIN v USING (term) WHERE term <> {lit(FILE_SEARCH)} AND abs(length(term) - {a}) <= 2),
w AS (SELECT doc_id, term, round_even(score, 4) AS match, ln(1 + (n - df + 0.5) / (df + 0.5)) * round_even(score, 4) * 0.45 AS weight FROM m, s WHERE e <= 2 AND score >= 0.72 AND NOT starts_with(term, {lit(FILE_SEARCH)})),
r AS (SELECT doc_id, sum(weight) AS raw, string_agg(term, ',' ORDER BY match DESC, term) AS terms, array_to_string(list_sort(list(term)), ',') AS files FROM w GROUP BY doc_id),
h AS (SELECT offense_id, event_index, event_id, round_even(raw, 4) AS score, terms, files FROM r JOIN docs USING (doc_id) ORDER BY score DESC, event_index, offense_id LIMIT {limit})"""


def host_hits() -> str:
    q = analyse(HOST_SEARCH)
    host = HOST_SEARCH.replace("exmple", "example")
    return f"""WITH {fuzzy_terms_cte(DOCS, [t for t in q.tokens if not q.weak(t)])}, r AS (SELECT doc_id, sum(weight) AS raw, string_agg(query_term || '>' || term || '>' || kind, ',' ORDER BY k) AS matched_terms FROM best JOIN (SELECT doc_id, term, query_term, kind FROM (SELECT doc_id, term, query_term FROM best) JOIN m USING (term, query_term)) USING (doc_id, term, query_term) GROUP BY doc_id)
SELECT offense_id, event_index, event_id, round_even(raw, 4) AS score, matched_terms, {lit(host)} AS matched_identifiers FROM r JOIN docs USING (doc_id) WHERE list_contains(hostname, {lit(host)}) ORDER BY score DESC, event_index, offense_id LIMIT 10"""


def values(columns: str, rows) -> str:
    told = ", ".join("(" + ", ".join(x if isinstance(x, Raw) else lit(x) if isinstance(x, str) else "NULL" if x is None else f"{str(x).lower()}{'::BIGINT' if type(x) is int else ''}" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {told}) t({columns})"


class Raw(str):
    """A piece of SQL among values."""


def route_steps() -> str:
    """The decisions, told by hand; counts are the table's."""
    every, ten = Raw("(SELECT count(*) FROM events)"), Raw("10::BIGINT")
    steps = (
        (("auto_routed", "exact_field", every), (("exact_field", True, "resolver_candidate_confident"),)),
        (("auto_routed", "bm25", ten), (("exact_field", False, "identifier_query_skips_exact_field"), ("bm25", True, "exact_identifier_match"))),
        (("auto_routed", "fuzzy", ten), (("exact_field", False, "identifier_query_skips_exact_field"), ("bm25", False, "no_bm25_results"), ("fuzzy", True, "fallback_after_bm25_weak_or_empty"))),
        (("auto_routed", "fuzzy", 0), (("exact_field", False, "no_resolver_candidate"), ("bm25", False, "no_bm25_results"), ("fuzzy", False, "fallback_after_bm25_weak_or_empty"))),
        (("exact_field", "exact_field", every), (("exact_field", True, "exact_field_only"),)),
        (("metadata_text", "bm25", ten), (("bm25", True, "bm25_score_useful"),)),
    )
    rows = [(*asked, *head, k, *step) for asked, (head, trace) in zip(ROUTES, steps, strict=True) for k, step in enumerate(trace)]
    return values("query, mode, search_mode, method, result_count, step, step_method, accepted, reason", rows)


def upload_checks() -> str:
    tail = (("pass", "save raw offense"), ("IDS", "missing utf8_payload.id"), ("pass", "extract metadata"), ("pass", "metadata offense_id"), ("pass", "metadata event count"), ("pass", "metadata identity"), ("pass", "metadata event indexes"), ("IDS", "metadata event_id"), ("warning", "sparse mapped fields"), ("pass", "discovery refresh"), ("pass", "search smoke exact"), ("pass", "search smoke metadata"))
    done = lambda level: tuple((level if a == "IDS" else a, b) for a, b in tail)
    events = ("pass", "events")
    outcome = (
        ("nothing", "failed", 0, (("error", "upload file"),)), ("path", "failed", 0, (("warning", "uploaded filename"), ("error", "events"))), ("bad name", "failed", 0, (("error", "uploaded filename"),)), ("no id", "failed", 0, (("error", "missing offense_id"),)),
        ("not utf-8", "failed", 0, (("error", "invalid JSON"),)), ("not json", "failed", 0, (("error", "invalid JSON"),)), ("list", "failed", 0, (("error", "json shape"),)), ("no events", "failed", 0, (("error", "events"),)), ("empty", "failed", 0, (("error", "events"),)),
        ("ids", "success", 2, (events, ("pass", "existing metadata output"), *done("warning"))),
        ("again", "failed", 0, (events, ("error", "existing raw file"), ("error", "existing metadata output"))),
        ("overwrite", "success", 2, (events, ("warning", "existing raw file"), ("warning", "existing metadata output"), *done("pass"))),
        ("other name", "failed", 0, (events, ("error", "existing raw filename"), ("error", "existing metadata output"))),
        ("replaced", "success", 2, (events, ("warning", "existing raw filename"), ("warning", "existing metadata output"), *done("pass"))),
    )
    return values("upload, status, events, n, level, checked", [(case, status, n, k, *c) for case, status, n, checks in outcome for k, c in enumerate(checks)])


TIMES = (
    "2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20.500+00:00", "2023-11-14T22:13:20+00:00", "2508-09-16T06:13:20.000+00:00", "2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20+00:00", "Unknown", "Unknown", "Unknown",
    "2026-01-02T03:04:05+00:00", "2026-01-02T01:04:05.678+00:00", "2026-01-02T00:00:00+00:00", "2025-12-29T00:00:00+00:00", "2027-01-03T00:00:00+00:00", "2025-12-29T10:00:00+00:00", "5138-11-16T09:46:40+00:00", "1970-01-01T00:00:00+00:00",
)
_MS = "make_timestamp(epoch_us(ts) // 1000 * 1000)"

ORACLES = {
    "mapped_fields": LONG,
    "json_records": LONG,
    "record_identity": f"WITH {RECORDS} SELECT offense_id, event_index, event_id, event_index AS load_ord, CAST(len(fs) AS BIGINT) AS non_empty FROM f",
    "search_documents": f"WITH {DOCS} SELECT offense_id, event_index, array_to_string(list_sort(tokens), ' ') AS tokens, " + " || '|' || ".join(f"array_to_string(list_sort({c}), ' ')" for c in ("ip", "hash", "uuid", "file_name", "registry_path", "hostname")) + " AS ids, CAST(shown AS BIGINT) AS shown FROM docs",
    "bm25_identifier": ranked(IP_SEARCH, 10, 0, "list_contains(vals, '192.0.2.7')", "'192.0.2.7'"),
    "bm25_records": ranked(TEXT_SEARCH, 25, 0.5, "true", "''"),
    "fuzzy_file": file_hits(10) + f" SELECT offense_id, event_index, event_id, score, array_to_string(list_transform(string_split(terms, ','), lambda x: {lit(FILE_SEARCH + '>')} || x || '>fuzzy'), ',') AS matched_terms, files AS matched_identifiers FROM h",
    "fuzzy_host": host_hits(),
    "display_rows": file_hits(10) + f" SELECT row_number() OVER (ORDER BY score DESC, event_index, offense_id) AS rank, offense_id, event_index, event_id, score, array_to_string(list_transform(string_split(terms, ','), lambda x: {lit(FILE_SEARCH + ' -> ')} || x || ' (fuzzy)'), ', ') AS matched_terms, replace(files, ',', ', ') AS matched_identifiers FROM h",
    "routes": route_steps(),
    "exact_answer": "SELECT DISTINCT '192.0.2.' || (user_id % 250) AS value, 'qradar.sourceip' AS field, (SELECT count(*) FROM events) AS event_count FROM events",
    "exact_events": f"WITH {RECORDS}, x AS (SELECT offense_id, event_index, event_id, list_filter(fs, lambda x: x.f = 'cisco.connector_guid') AS g FROM f) SELECT offense_id, event_index, event_id, g[1].v[1] AS value FROM x WHERE len(g) > 0",
    "stored_scope": f"WITH {RECORDS} SELECT offense_id, event_index, event_id, list_filter(fs, lambda x: x.f = 'actions.name')[1].v[1] AS name FROM f WHERE offense_id = (SELECT max(offense_id) FROM f)",
    "stored_scopes": f"WITH {EVENTS} SELECT offense_id, event_index, event_index AS load_ord FROM e",
    "file_inventory": f"""SELECT CAST(user_id AS VARCHAR) AS offense_id, count(*) AS number_of_events, {iso(f'min({_MS})')} AS first_event_time, {iso(f'max({_MS})')} AS last_event_time, CAST(user_id % 5 AS VARCHAR) AS logsourceid, 'records/offense_id=' || user_id AS metadata_file_path,
 CASE WHEN user_id % 3 = 0 OR user_id % 4 = 0 THEN 'Unknown' ELSE 'raw/offense_' || user_id || '_part0.json' END AS raw_offense_file_path FROM events GROUP BY user_id""",
    "no_inventory": "SELECT CAST(0 AS BIGINT) AS n",
    "raw_match": "WITH u AS (SELECT DISTINCT user_id AS n FROM events), x AS (SELECT CAST(n AS VARCHAR) AS offense_id, CAST((n % 3 <> 0)::INT + (n % 4 = 0)::INT AS BIGINT) AS raw_files, n % 5 <> 0 AS has_records FROM u) SELECT *, raw_files = 1 AS ok FROM x WHERE raw_files > 0 OR has_records",
    "validation_counts": f"""WITH {RECORDS}, x AS (SELECT *, len(fs) AS n FROM f) SELECT count(*) AS events, CAST(min(n) AS BIGINT) AS non_empty_field_min, CAST(max(n) AS BIGINT) AS non_empty_field_max, count(*) FILTER (n < {SPARSE_FIELDS}) AS sparse, count(*) FILTER (event_id IS NULL) AS no_id,
 count(*) FILTER (offense_id <> '7') AS other, CAST(0 AS BIGINT) AS no_fields, CAST(0 AS BIGINT) AS no_index, (SELECT count(*) FROM (SELECT event_index FROM f GROUP BY event_index HAVING count(*) > 1)) AS duplicates, round_even(sum(n) / count(*)::DOUBLE, 2) AS non_empty_field_avg FROM x""",
    "mapping_coverage": values("what, names", [("without_alias", ""), ("without_mapping", ""), ("without_description", ""), ("broken_without_alias", "a"), ("broken_without_mapping", "c"), ("broken_without_description", "b")]),
    "time_shapes": values("n, told", list(enumerate(TIMES))),
    "payload_shapes": values("n, id, told, listed", [(0, 1, "object", ""), (1, 2, "1|1|2", "1|2"), *[(k, None, None, "") for k in range(2, 7)], (7, 8, "e n 1 k z t true url http://a.b:80/x", "")]),
    "intake_checks": upload_checks(),
    "empty_table": "SELECT CAST(0 AS BIGINT) AS long_rows, CAST(0 AS BIGINT) AS documents",
}

# The index has to give what the searches without it give.
ORACLES |= {
    "index_build": f"WITH {docs()}, t AS (SELECT doc_id, unnest(tokens) AS term FROM docs), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens, (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms FROM c",
    "index_bm25": PLAIN["bm25_topk"], "index_fuzzy": PLAIN["fuzzy_topk"], "index_bm25_identifier": ORACLES["bm25_identifier"], "index_fuzzy_file": ORACLES["fuzzy_file"], "index_fuzzy_host": ORACLES["fuzzy_host"], "index_routes": ORACLES["routes"],
}
