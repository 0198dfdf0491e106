"""Routed search: exact field, then BM25, then fuzzy, with a trace of every decision.

Each step is one lazy DataFrame; control comes back to the driver only for the few rows that decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import DataFrame

from ..config import STRONG_REASONS, THRESHOLDS
from .documents import record_documents
from .exact import Answer, answer
from .index import SearchIndex
from .resolve import resolve_one
from .search import Query, analyse, bm25, fuzzy

MODES = ("auto", "exact", "metadata-text")


@dataclass
class Response:
    query: str
    search_mode: str
    method: str
    result_count: int
    route: list[dict[str, Any]]
    result: Any
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))


def field_decision(found: list[dict], q: Query) -> dict:
    """Whether the best candidate field is sure enough to answer exactly, and why."""
    top = found[0] if found else None
    gap = None
    if top:
        gap = round(top["score"] - (found[1]["score"] if len(found) > 1 else 0.0), 4)
    tied = [c for c in found if top and (c["score"], c["reason"], c["matched_alias"]) == (top["score"], top["reason"], top["matched_alias"])]
    rules = (
        (bool(q.ids), False, "identifier_query_skips_exact_field"),
        (top is None, False, "no_resolver_candidate"),
        (top and top["reason"] == "alias_phrase_in_question" and top["phrase_words"] == 1 < top["question_words"], False, "single_token_alias_inside_multi_token_query"),
        (top and top["score"] < THRESHOLDS["exact_field_min_score"], False, "resolver_score_below_threshold"),
        (top and top["reason"] not in STRONG_REASONS, False, "resolver_reason_not_strong"),
        (top and gap < THRESHOLDS["exact_field_min_gap"] and len(tied) > 1, True, "resolver_tied_exact_alias_candidates"),
        (top and gap < THRESHOLDS["exact_field_min_gap"], False, "resolver_candidate_ambiguous"),
        (True, True, "resolver_candidate_confident"),
    )
    accepted, reason = next((a, r) for hit, a, r in rules if hit)
    return {"method": "exact_field", "accepted": accepted, "reason": reason, "top_match": top, "gap": gap, "matches": found}


def bm25_decision(rows: list, q: Query) -> tuple[bool, str]:
    """Whether BM25's best row is worth showing, and why."""
    if not rows:
        return False, "no_bm25_results"
    top = rows[0]
    exact = [m["query_term"] for m in top["matched_terms"] if m["match_type"] == "exact"]
    if top["score"] <= 0:
        return False, "bm25_score_not_positive"
    if not exact:
        return False, "no_exact_matched_terms"
    if q.ids:
        return (True, "exact_identifier_match") if top["matched_identifiers"] else (False, "identifier_query_without_exact_identifier_match")
    if top["score"] >= THRESHOLDS["bm25_min_score_non_identifier"]:
        return True, "bm25_score_useful"
    if any(len(t) >= THRESHOLDS["bm25_long_exact_token_min_length"] for t in exact):
        return True, "long_exact_free_text_match"
    return False, "bm25_score_below_threshold"


def text_route(docs: DataFrame | SearchIndex, query: str, limit: int = 10, mode: str = "metadata_text", route: list | None = None) -> Response:
    """BM25, and fuzzy where that is of no use, over documents or a stored index of them."""
    q, route = analyse(query), list(route or [])
    ranked, near = (docs.bm25, docs.fuzzy) if isinstance(docs, SearchIndex) else (partial(bm25, docs), partial(fuzzy, docs))
    rows = ranked(q, limit).collect()  # at most `limit` rows
    useful, reason = bm25_decision(rows, q)
    route.append({"method": "bm25", "accepted": useful, "reason": reason})
    if useful:
        return Response(query, mode, "bm25", len(rows), route, rows)
    rows = near(q, limit).collect()
    route.append({"method": "fuzzy", "accepted": bool(rows), "reason": "fallback_after_bm25_weak_or_empty"})
    return Response(query, mode, "fuzzy", len(rows), route, rows)


def route(records: DataFrame, query: str, mode: str = "auto", limit: int = 10, aliases: dict | None = None, index: SearchIndex | DataFrame | None = None) -> Response:
    """Answer a question over records by the first method that is sure of itself. With an index or stored documents of them texts are not analysed again."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    query = query.strip()
    if not query:
        return Response(query, mode, "exact_field", 0, [], Answer(query))
    shown = {"auto": "auto_routed"}.get(mode, mode.replace("-", "_"))
    if mode == "exact":
        found = answer(records, query, aliases)
        return Response(query, "exact_field", "exact_field", found.event_count, [{"method": "exact_field", "accepted": True, "reason": "exact_field_only"}], found)
    trace: list[dict] = []
    if mode == "auto":
        step = field_decision(resolve_one(records.sparkSession, query, aliases), analyse(query))
        if step["accepted"]:
            found = answer(records, query, aliases)
            if found.event_count:
                return Response(query, shown, "exact_field", found.event_count, [step | {"outcome": "exact_field_confident_and_useful"}], found)
            step = step | {"accepted": False, "outcome": "exact_field_empty_or_not_useful"}
        trace.append(step)
    if index is not None:
        return text_route(index, query, limit, shown, trace)
    docs = record_documents(records).persist()  # read by both methods
    try:
        return text_route(docs, query, limit, shown, trace)
    finally:
        docs.unpersist()
