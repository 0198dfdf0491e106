"""Scores as columns: IDF, BM25, fuzzy similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, FUZZY_LEAST_RATIO


def idf(documents, frequency) -> Column:
    n, df = (x if isinstance(x, Column) else F.lit(float(x)) for x in (documents, frequency))
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25_term(weight, tf: Column, length: Column, mean_length) -> Column:
    """The share of one term; a document without tokens scores nothing."""
    mean = mean_length if isinstance(mean_length, Column) else F.lit(float(mean_length))
    score = weight * (tf * (BM25_K1 + 1)) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.greatest(mean, F.lit(1.0))))
    return F.when(tf > 0, score).otherwise(F.lit(0.0))


def fuzzy_limit(query: Column) -> Column:
    n = F.length(query)
    return F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def fuzzy_match(query: Column, term: Column) -> Column:
    """struct<score double, kind string>: exact, partial (a prefix), fuzzy (few edits), or score 0 without a kind."""
    a, b = F.length(query), F.length(term)
    short, long = F.least(a, b), F.greatest(a, b)
    limit = fuzzy_limit(query)
    edits = F.levenshtein(query, term)
    ratio = F.lit(1.0) - edits / long

    def result(score, kind):
        return F.struct(score.cast("double").alias("score"), F.lit(kind).cast("string").alias("kind"))

    none = result(F.lit(0.0), None)
    near = (short > 4) & (F.abs(a - b) <= limit)
    return (
        F.when(query == term, result(F.lit(1.0), "exact"))
        .when(short < 4, none)
        .when(query.startswith(term) | term.startswith(query), result(short / long, "partial"))
        .when(~near, none)
        .when((edits <= limit) & (ratio >= FUZZY_LEAST_RATIO), result(ratio, "fuzzy"))
        .otherwise(none)
    )
