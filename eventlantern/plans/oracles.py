"""The same queries as DuckDB SQL, written against the driver's tables.

RE2 has no look-ahead, so hosts are matched as whole runs and judged by the run's characters.
"""

from __future__ import annotations

from ..config import QUESTION_STOPWORDS, SEARCH_STOPWORDS, load_aliases, load_mapping
from ..functions.identifiers import DOTTED, FILE, HASH, IP, NUMERIC, REGISTRY, TRIM, UUID
from ..functions.text import words_of
from .queries import HOST_QUERY, IP_QUERY, QUERY, QUESTIONS, TYPO

RUN = r"\b([A-Za-z0-9][A-Za-z0-9.-]{2,}[A-Za-z0-9])\b[.-]*[A-Za-z0-9]*"
DASHED_RUN = r"\b([A-Za-z0-9][A-Za-z0-9-]{2,}[A-Za-z0-9])\b-*[A-Za-z0-9]*"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]" if xs else "CAST([] AS VARCHAR[])"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str, stop=SEARCH_STOPWORDS) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '' AND NOT list_contains({strings(stop)}, w))"


def canon(x: str) -> str:
    low = f"lower(trim(trim({x}), {lit(TRIM)}))"
    hive = rf"regexp_matches({low}, '^(\\|hkey_|hklm|hkcu|hkcr|hku)')"
    return rf"regexp_replace(CASE WHEN {hive} THEN replace({low}, '/', '\') ELSE {low} END, '\\+', '\\', 'g')"


def found(pattern: str, text: str = "pre") -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, {lit(pattern)}), lambda x: {canon('x')}), lambda x: x <> ''))"


def whole(x: str, pattern: str) -> str:
    body = pattern.removeprefix("(?i)")
    return f"regexp_matches({x}, {lit(('(?i)' if body != pattern else '') + '^(' + body + ')$')})"


def runs(pattern: str, tests: str) -> str:
    pairs = f"list_zip(regexp_extract_all(pre, {lit(pattern)}, 0), regexp_extract_all(pre, {lit(pattern)}, 1))"
    return f"list_distinct(list_transform(list_filter({pairs}, lambda p: {tests}), lambda p: {canon('p[2]')}))"


def ids(table: str, key: str, text: str) -> str:
    """CTEs ending in `ids`: key, text and one list for each category."""
    hostlike = f"NOT {whole('x', FILE)} AND NOT {whole('x', NUMERIC)}"
    host = runs(RUN, "regexp_matches(p[1], '[A-Za-z]') AND contains(p[1], '.')")
    dashed = runs(DASHED_RUN, "regexp_matches(p[1], '[A-Za-z]') AND regexp_matches(p[1], '[0-9]') AND contains(p[1], '-')")
    return f"""pre AS (SELECT *, regexp_replace(coalesce({text}, ''), '[^\\x00-\\x7F\\P{{L}}]', '_', 'g') AS pre, {text} AS txt FROM {table}),
plain AS (SELECT *, {found(IP)} AS ip, list_filter({found(DOTTED)}, lambda x: NOT {whole('x', IP)}) AS dotted_numeric, {found(HASH)} AS hash, {found(UUID)} AS uuid, {found(FILE)} AS file_name, {found(REGISTRY)} AS registry_path,
  list_filter({host}, lambda x: x <> '' AND {hostlike}) AS raw_hosts, list_filter({dashed}, lambda x: x <> '' AND {hostlike}) AS raw_dashed FROM pre),
hosts AS (SELECT *, list_filter(raw_hosts, lambda x: NOT list_contains(list_concat(ip, dotted_numeric, hash, uuid, file_name, registry_path), x)) AS own FROM plain),
ids AS (SELECT *, list_distinct(list_concat(own, list_filter(raw_dashed, lambda x: len(list_filter(own, lambda h: contains(h, x))) = 0))) AS hostname FROM hosts)"""


ALL = "list_concat(ip, dotted_numeric, hash, uuid, file_name, registry_path, hostname)"


def docs(table: str = "documents", key: str = "doc_id", text: str = "text", where: str = "true") -> str:
    """CTEs ending in `docs`: doc_id, source, tokens, all identifiers."""
    source = "source" if table == "documents" else "'all' AS source"
    return f"{ids(f'(SELECT * FROM {table} WHERE {where})', key, text)},\ndocs AS (SELECT {key} AS doc_id, {source}, list_concat({words('txt')}, {ALL}) AS tokens, {ALL} AS vals FROM ids)"


def unnested(category: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"WITH {ids(table, key, text)} SELECT {key}, unnest({category}) AS value FROM ids"


IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
TERM = f"{IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avgdl, 1.0)))"


def bm25(where: str, limit: int) -> str:
    q = list(dict.fromkeys(words_of(QUERY)))
    return f"""WITH {docs(where=where)}, s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs), q AS (SELECT unnest({strings(q)}) AS term, unnest(range({len(q)})) AS k),
t AS (SELECT doc_id, len(tokens) AS len, term, k, len(list_filter(tokens, lambda x: x = term)) AS tf FROM docs, q), d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM t GROUP BY term),
r AS (SELECT doc_id, sum({TERM}) AS raw, string_agg(term || '>' || term, ',' ORDER BY k) AS matched_terms FROM t JOIN d USING (term), s WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, round_even(raw, 4) AS score, matched_terms, '' AS matched_identifiers FROM r WHERE raw > 0 ORDER BY score DESC, doc_id LIMIT {limit}"""


def fuzzy_terms_cte(table: str | None = None, tokens: list[str] | None = None) -> str:
    q = tokens or list(dict.fromkeys(words_of(TYPO)))
    return f"""{table or docs()}, s AS (SELECT count(*) AS n FROM docs), q AS (SELECT unnest({strings(q)}) AS query_term, unnest(range({len(q)})) AS k),
post AS (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM docs), v AS (SELECT term, count(*) AS df FROM post GROUP BY term),
p AS (SELECT *, length(query_term) AS a, length(term) AS b, levenshtein(query_term, term) AS e, CASE WHEN length(query_term) <= 4 THEN 1 WHEN length(query_term) <= 8 THEN 2 ELSE 3 END AS lim FROM v, q WHERE length(term) >= 4 AND length(query_term) >= 4 AND term <> query_term),
m AS (SELECT query_term, k, term, df, CASE WHEN starts_with(query_term, term) OR starts_with(term, query_term) THEN 'partial' ELSE 'fuzzy' END AS kind,
 CASE WHEN starts_with(query_term, term) OR starts_with(term, query_term) THEN least(a, b) / greatest(a, b)::DOUBLE ELSE 1 - e / greatest(a, b)::DOUBLE END AS score
 FROM p WHERE starts_with(query_term, term) OR starts_with(term, query_term) OR (abs(a - b) <= lim AND e <= lim AND least(a, b) > 4 AND 1 - e / greatest(a, b)::DOUBLE >= 0.72)),
w AS (SELECT doc_id, query_term, k, term, score, df, {IDF} * score * 0.45 AS weight FROM post JOIN m USING (term), s),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, query_term ORDER BY weight DESC, term DESC) AS nth FROM w) WHERE nth = 1)"""


def fuzzy_hits() -> str:
    return f"WITH {fuzzy_terms_cte()}, r AS (SELECT doc_id, sum(weight) AS raw, string_agg(query_term || '>' || term, ',' ORDER BY k) AS matched_terms FROM best GROUP BY doc_id)"


def resolve() -> str:
    phrases = ", ".join(f"({lit(f)}, {k}, {lit(p)})" for f, ps in load_aliases().items() for k, p in enumerate([f, *ps]))
    asked = ", ".join(f"({k}, {lit(q)})" for k, q in enumerate(QUESTIONS))

    def pad(x: str) -> str:
        return f"(' ' || array_to_string({x}, ' ') || ' ')"

    return f"""WITH a AS (SELECT *, {norm('phrase')} AS pn, {words('phrase', QUESTION_STOPWORDS)} AS pw FROM (VALUES {phrases}) t(field, ord, phrase)), q AS (SELECT *, {norm('question')} AS qn, {words('question', QUESTION_STOPWORDS)} AS qw FROM (VALUES {asked}) t(question_id, question)),
c AS (SELECT *, len(list_distinct(pw)) AS np, len(list_distinct(qw)) AS nq, len(list_intersect(list_distinct(pw), list_distinct(qw))) AS shared FROM q, a WHERE len(pw) > 0),
j AS (SELECT *, CASE WHEN pn = qn THEN 'exact_question_match' WHEN contains({pad('qw')}, {pad('pw')}) THEN 'alias_phrase_in_question' WHEN len(qw) > 0 AND contains({pad('pw')}, {pad('qw')}) THEN 'question_phrase_in_alias' ELSE 'token_overlap' END AS reason FROM c),
sc AS (SELECT *, CASE reason WHEN 'exact_question_match' THEN 1.0::DOUBLE WHEN 'alias_phrase_in_question' THEN 0.90::DOUBLE + least(np, 5) * 0.01::DOUBLE WHEN 'question_phrase_in_alias' THEN 0.75::DOUBLE
 ELSE (0.65::DOUBLE * (shared / np::DOUBLE) + 0.35::DOUBLE * (shared / greatest(nq, 1)::DOUBLE)) * CASE WHEN np = 1 AND nq > 1 THEN 0.70::DOUBLE ELSE 1.0::DOUBLE END END AS raw FROM j),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, field ORDER BY raw DESC, ord) AS nth FROM sc) WHERE nth = 1 AND raw >= 0.25),
r AS (SELECT CAST(question_id AS BIGINT) AS question_id, row_number() OVER (PARTITION BY question_id ORDER BY round_even(raw, 4) DESC, field) AS rank, field, round_even(raw, 4) AS score, phrase AS matched_alias, reason FROM b) SELECT * FROM r WHERE rank <= 5"""


USER = "CAST(user_id AS VARCHAR)"
PLACE = f"SELECT *, {USER} AS offense_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_index, json_extract_string(props, '$.k') AS k FROM events"


def iso(x: str, digits: int = 3) -> str:
    """Text of a timestamp with milliseconds cut off where there is a part of a second."""
    return f"CASE WHEN epoch_us({x}) % 1000000 > 0 THEN strftime(date_trunc('milliseconds', {x}), '%Y-%m-%dT%H:%M:%S.%g') ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S') END || '+00:00'"


def host_query(test: str) -> str:
    return f"WITH {ids('pages', 'page_id', 'url')}, h AS (SELECT page_id, unnest(hostname) AS host FROM ids) SELECT page_id, host FROM h WHERE {test}"


def near_host() -> str:
    """Every text segment of the query's host within its edits of some segment of the host at hand, 0.82 in the mean."""
    segs = [s for s in HOST_QUERY.replace("-", ".").split(".") if s]

    def best(s: str) -> str:
        lim = 1 if len(s) <= 4 else 2 if len(s) <= 8 else 3
        prefix = f"length(x) >= 4 AND {len(s)} >= 4 AND (starts_with(x, {lit(s)}) OR starts_with({lit(s)}, x))"
        ratio = f"1 - levenshtein({lit(s)}, x) / greatest(length(x), {len(s)})::DOUBLE"
        near = f"least(length(x), {len(s)}) > 4 AND abs(length(x) - {len(s)}) <= {lim} AND levenshtein({lit(s)}, x) <= {lim} AND {ratio} >= 0.72"
        return f"coalesce(list_max(list_transform(segs, lambda x: CASE WHEN x = {lit(s)} THEN 1.0::DOUBLE WHEN {prefix} THEN least(length(x), {len(s)}) / greatest(length(x), {len(s)})::DOUBLE WHEN {near} THEN {ratio} ELSE 0.0::DOUBLE END)), 0.0)"

    scores = ", ".join(f"{best(s)} AS s{k}" for k, s in enumerate(segs))
    names = [f"s{k}" for k in range(len(segs))]
    return f"""WITH {ids('pages', 'page_id', 'url')}, h AS (SELECT page_id, unnest(hostname) AS host FROM ids), g AS (SELECT *, list_filter(regexp_split_to_array(host, '[.-]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')) AS segs FROM h WHERE NOT contains(host, {lit(HOST_QUERY)})),
r AS (SELECT page_id, host, {scores} FROM g) SELECT page_id, host FROM r WHERE least({', '.join(names)}, 1.0) > 0 AND ({' + '.join(names)}) / {len(segs)}.0 >= 0.82"""


def word_sets() -> str:
    def side(s: str) -> str:
        return f"SELECT DISTINCT unnest({words('text')}) AS term FROM documents WHERE {s} coalesce(lang = 'en', false)"

    return f"""WITH a AS ({side('')}), b AS ({side('NOT')}) SELECT 'both' AS what, count(*) AS n FROM (SELECT term FROM a INTERSECT SELECT term FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT term FROM a UNION SELECT term FROM b)
UNION ALL SELECT 'first_only', count(*) FROM (SELECT term FROM a EXCEPT SELECT term FROM b)"""


ORACLES = {
    "payload_path_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "payload_fallback_path": f"SELECT offense_id, event_index, coalesce(json_extract_string(props, '$.missing'), k) AS k, CAST(0 AS BIGINT) AS n_none FROM ({PLACE})",
    "array_collect_dedup": "WITH f AS (SELECT user_id, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY t, e) AS event_types FROM f GROUP BY user_id",
    "records_long": " UNION ALL ".join(f"SELECT offense_id, event_index, '{f}' AS field, CAST(0 AS BIGINT) AS pos, {v} AS value FROM ({PLACE}) WHERE {v} IS NOT NULL AND {v} <> ''" for f, v in (("type", "event_type"), ("user", USER), ("k", "k"))),
    "event_index": f"SELECT offense_id, event_id, event_index FROM ({PLACE})",
    "exact_field_values": "SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL",
    "exact_field_count": f"SELECT {USER} AS offense_id, count(event_type) AS event_count, CAST(0 AS BIGINT) AS none_count FROM events GROUP BY 1",
    "exact_tied_fields": "SELECT DISTINCT event_type AS value FROM events UNION SELECT json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "matching_event_rows": f"SELECT offense_id, event_index, event_type FROM ({PLACE}) WHERE k = '7'",
    "resolve_field": resolve(),
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "word_tokens_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term FROM documents) GROUP BY ALL",
    "document_frequency": f"WITH {docs()} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term",
    "corpus_stats": f"WITH {docs()} SELECT count(*) AS n, round_even(avg(len(tokens)), 6) AS avgdl FROM docs",
    "idf": f"WITH {docs()}, s AS (SELECT count(*) AS n FROM docs), v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term) SELECT term, round_even({IDF}, 4) AS idf FROM v, s",
    "bm25_topk": bm25("true", 10),
    "bm25_scoped": bm25("source = 'src3'", 5),
    "bm25_batch": f"""WITH {docs()}, s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs), {ids('benchmark', 'item_id', 'text').replace('pre AS', 'pre2 AS').replace('FROM pre)', 'FROM pre2)').replace('plain AS', 'plain2 AS').replace('FROM plain)', 'FROM plain2)').replace('hosts AS', 'hosts2 AS').replace('FROM hosts)', 'FROM hosts2)').replace('ids AS', 'ids2 AS')},
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_concat({words('txt')}, {ALL})) AS term FROM ids2), t AS (SELECT doc_id, len(tokens) AS len, unnest(tokens) AS term FROM docs), c AS (SELECT doc_id, len, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
r AS (SELECT query_id, doc_id, round_even(sum({TERM}), 4) AS score FROM q JOIN c USING (term) JOIN d USING (term), s GROUP BY query_id, doc_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) SELECT * FROM k WHERE rank <= 10""",
    "identifiers_ip": unnested("ip"), "identifiers_dotted": unnested("dotted_numeric"), "identifiers_hash": unnested("hash"), "identifiers_uuid": unnested("uuid"), "identifiers_filename": unnested("file_name"),
    "identifiers_registry": unnested("registry_path", "pages", "page_id", "html"), "identifiers_hostname": unnested("hostname"), "identifiers_url_host": unnested("hostname", "pages", "page_id", "url"),
    "query_type": f"WITH {ids('benchmark', 'item_id', 'text')} SELECT item_id, CASE WHEN len({ALL}) > 0 THEN 'identifier_like' ELSE 'free_text' END AS query_type FROM ids",
    "identifier_gate": f"WITH {ids('documents', 'doc_id', 'text')}, f AS (SELECT coalesce(min(v), '{IP_QUERY}') AS v FROM (SELECT unnest(ip) AS v FROM ids)) SELECT doc_id, v AS matched FROM ids, f WHERE list_contains({ALL}, v)",
    "fuzzy_terms": f"WITH {fuzzy_terms_cte()} SELECT query_term, term, round_even(score, 4) AS score, kind, df FROM m",
    "best_fuzzy_match": f"WITH {fuzzy_terms_cte()} SELECT doc_id, query_term, term, round_even(score, 4) AS match, round_even(weight, 4) AS weight FROM best",
    "fuzzy_topk": fuzzy_hits() + " SELECT doc_id, round_even(raw, 4) AS score, matched_terms, '' AS matched_identifiers FROM r WHERE raw > 0 ORDER BY score DESC, doc_id LIMIT 10",
    "routed_search": fuzzy_hits() + " SELECT 'fuzzy' AS method, doc_id, round_even(raw, 4) AS score, row_number() OVER (ORDER BY round_even(raw, 4) DESC, doc_id) - 1 AS rank FROM r WHERE raw > 0 ORDER BY rank LIMIT 10",
    "host_fuzzy": near_host(),
    "host_containment": host_query("contains(host, 'example.net')"),
    "inventory": f"""WITH e AS (SELECT {USER} AS offense_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS t, event_type FROM events), m AS (SELECT offense_id, event_type, row_number() OVER (PARTITION BY offense_id ORDER BY count(*) DESC, event_type) AS nth FROM e GROUP BY offense_id, event_type)
SELECT e.offense_id, count(*) AS number_of_events, {iso('min(t)')} AS first_event_time, {iso('max(t)')} AS last_event_time, any_value(m.event_type) AS logsourceid FROM e JOIN m ON e.offense_id = m.offense_id AND nth = 1 GROUP BY e.offense_id""",
    "epoch_to_timestamp": f"SELECT event_id, {iso('make_timestamp(epoch_us(ts) // 1000000 * 1000000)')} AS from_s, {iso('make_timestamp(epoch_us(ts) // 1000 * 1000)')} AS from_ms, {iso('ts')} AS from_us, {iso('ts')} AS from_ns FROM events",
    "field_density": f"WITH r AS (SELECT {USER} AS offense_id, (event_type IS NOT NULL AND event_type <> '')::INT + (user_id IS NOT NULL)::INT + (json_extract_string(props, '$.k') IS NOT NULL)::INT AS c FROM events) SELECT offense_id, CAST(min(c) AS BIGINT) AS low, round_even(avg(c), 2) AS mean, CAST(max(c) AS BIGINT) AS high FROM r GROUP BY 1",
    "sparse_rows": f"SELECT {USER} AS offense_id, count(*) AS sparse FROM events GROUP BY 1",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "missing_ids": f"SELECT {USER} AS offense_id, count(*) FILTER (json_extract_string(props, '$.id') IS NULL) AS missing FROM events GROUP BY 1",
    "coverage_check": f"SELECT CAST(0 AS BIGINT) AS gaps, CAST({len(load_mapping())} AS BIGINT) AS fields",
    "identifier_sets": word_sets(),
    "scope_scan": "SELECT doc_id, lang FROM documents WHERE source = 'src5'",
    "combined_scopes": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS load_ord FROM documents",
    "intake_stream": f"SELECT offense_id, event_index, event_type FROM ({PLACE})",
}
