"""What a person sees of results: ranks, matched terms as text, values as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import UI_LIMITS
from .search import KEY, Query, analyse, search


def clamped(limit: int) -> int:
    """A limit within what the page offers."""
    return max(UI_LIMITS[0], min(UI_LIMITS[1], int(limit)))


def term_text(terms: Column) -> Column:
    """`term (kind)`, or `asked -> found (kind)` where they differ, in order."""

    def one(m: Column) -> Column:
        found = F.concat(m["matched_term"], F.lit(" ("), m["match_type"], F.lit(")"))
        return F.when(m["query_term"] == m["matched_term"], found).otherwise(F.concat(m["query_term"], F.lit(" -> "), found))

    return F.array_join(F.transform(terms, one), ", ")


def result_rows(docs: DataFrame, query: str, mode: str = "bm25", limit: int = 10) -> DataFrame:
    """(rank, offense_id, event_index, event_id, score, matched_terms, matched_identifiers) with ranks from 1."""
    found = search(docs, query, mode, clamped(limit))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "event_index", *KEY)).cast("long")  # at most ten rows
    return found.select(rank.alias("rank"), "offense_id", "event_index", "event_id", "score", term_text(F.col("matched_terms")).alias("matched_terms"), F.array_join("matched_identifiers", ", ").alias("matched_identifiers"))


def envelope(query: str, mode: str, rows: list) -> dict:
    """A search result with what the query was taken for; with or without rows."""
    q: Query = analyse(query)
    return {"query": query, "method": mode, "query_type": q.kind, "query_identifiers": q.ids, "results": rows}


def route_rows(route: list[dict]) -> list[dict]:
    """The steps of a route, numbered from 1."""
    return [{"step": k, **step} for k, step in enumerate(route, 1)]
