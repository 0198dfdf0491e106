"""DuckDB SQL of those corpus queries that SQL can express."""

from __future__ import annotations

import re

from .chat import CLOSE, CONTROL, OPEN
from .decontaminate import THRESHOLD as CONTAINMENT
from .decontaminate import WIDTH
from .licenses import PHRASES, TEMPLATES, THRESHOLD, WORD
from .repeats import LENGTH
from .secrets import RULES

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decontaminate() -> str:
    words = rf"regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+')"
    runs = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
    return f"""WITH it AS (SELECT *, least(len(w), {WIDTH}) AS k FROM (SELECT DISTINCT item_id, text, {words} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT item_id, k, {runs} AS own FROM it), sh AS (SELECT item_id, k, len(own) AS n, unnest(own) AS sh FROM s),
d AS (SELECT doc_id, w, row_number() OVER () AS r FROM (SELECT doc_id, {words} AS w FROM documents)), ks AS (SELECT DISTINCT k FROM it), dsh AS (SELECT doc_id, r, k, unnest({runs}) AS sh FROM d, ks WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS shared, CAST(any_value(n) AS BIGINT) AS item_shingles, count(*) / any_value(n)::DOUBLE AS containment FROM dsh JOIN sh USING (k, sh) GROUP BY doc_id, r, item_id HAVING count(*) >= ceil({CONTAINMENT}::DOUBLE * any_value(n) - 1e-9)"""


def secrets() -> str:
    def rule(k: int, r) -> str:
        p = lit(r.pattern)
        return f"""SELECT r, {k} AS ord, '{r.kind}' AS kind, list_sum(list_transform(p[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS s, length(m[i + 1]) AS n, length(g[i + 1]) AS told, {r.least} AS least FROM
 (SELECT r, m, g, p, unnest(range(len(m))) AS i FROM (SELECT r, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {r.group}) AS g, string_split_regex(text, {p}) AS p FROM d WHERE regexp_matches(text, {p})))"""

    base = [r.kind for r in RULES if r.base]
    told = "kind || ':' || s || ':' || (s + n)"
    mine = "kind IN (" + ", ".join(map(lit, base)) + ")"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents), f AS ({' UNION ALL '.join(rule(k, r) for k, r in enumerate(RULES))}),
g AS (SELECT r, ord, kind, CAST(s AS BIGINT) AS s, n FROM f WHERE told >= least),
a AS (SELECT d.r, doc_id, {counts}, coalesce(string_agg({told}, ',' ORDER BY s, ord) FILTER ({mine}), '') AS own, coalesce(string_agg({told}, ',' ORDER BY s, ord) FILTER (kind IS NOT NULL), '') AS spans FROM d LEFT JOIN g USING (r) GROUP BY ALL)
SELECT doc_id, {', '.join(f'n_{k}' for k in base)}, sha256(own) AS base_sha256, spans FROM a"""


def repeats() -> str:
    """Every window of LENGTH bytes as hexadecimal text, cut out of pieces of a kilobyte; runs of repeated windows are islands."""
    return f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, c, substring(h, 2048 * c + 1, 2048 + {2 * LENGTH - 2}) AS piece FROM (SELECT r, h, unnest(range((len(h) + 2047) // 2048)) AS c FROM d)),
w AS (SELECT r, 1024 * c + i AS p, substring(piece, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT r, c, piece, unnest(range(least(1024, len(piece) // 2 - {LENGTH - 1}))) AS i FROM c WHERE len(piece) >= {2 * LENGTH})),
f AS (SELECT s, min(r * 1000000000 + p) AS m FROM w GROUP BY s), l AS (SELECT r, p FROM w JOIN f USING (s) WHERE r * 1000000000 + p > m),
g AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM l), n AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
x AS (SELECT r, k, min(p) AS a, max(p) + {LENGTH} AS b FROM n GROUP BY r, k), y AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM x),
t AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""


def licenses() -> str:
    def places(phrase: str) -> str:
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        return f"list_filter(range(1, len(w) + 1), lambda i: coalesce({test}, false))"

    named = ", ".join(f"{places(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))
    every = "list_concat(" + ", ".join(f"p{k}" for k in range(len(PHRASES))) + ")"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "], lambda x: x IS NOT NULL)"
    table = ", ".join(f"('{label}', {sorted(set(t.split()))})" for label, t in TEMPLATES)
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {LOW} AS low FROM documents), t AS (SELECT * FROM (VALUES {table}) v(label, own)),
l AS (SELECT r, list_distinct(regexp_extract_all(line, '{WORD}')) AS held FROM (SELECT r, unnest(string_split(low, chr(10))) AS line FROM d)),
m AS (SELECT r, label, len(list_intersect(held, own)) / len(own)::DOUBLE AS score FROM l, t WHERE len(list_intersect(held, own)) >= ceil({THRESHOLD}::DOUBLE * len(own) - 1e-9)),
g AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM m GROUP BY r),
p AS (SELECT r, doc_id, w, {named} FROM (SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS w FROM d)), b AS (SELECT *, {every} AS starts, {base} AS base FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) - 1 AS BIGINT) AS first_word, CAST(list_max(starts) - 1 AS BIGINT) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels, CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score FROM b LEFT JOIN g USING (r)"""


def chat() -> str:
    control = lit("|".join(re.escape(c) for c in CONTROL))

    def escaped(x: str) -> str:
        return rf"(length({x}) + length({x}) - length(replace({x}, '\', '')) + len(regexp_extract_all(replace({x}, '\', '\\'), {control})))"

    frame = len(OPEN) + len(CLOSE) + 2
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
 CAST(sum({frame} + {escaped('role')} + len(regexp_extract_all(role, chr(10))) + {escaped('text')}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""


ORACLES = {"op1_decontaminate": decontaminate(), "op3_secrets": secrets(), "op4_repeats": repeats(), "op7_licenses": licenses(), "op9_chat": chat()}
