"""Resolving a question to fields through alias phrases: a join of questions with a table of phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RESOLVE_THRESHOLD, RESOLVE_TOP, load_aliases
from ..functions.text import contains_sequence, normalize, question_words

MOST_PHRASES = 100_000


def phrase_table(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(field, ord, phrase, p_norm, p_words): the field's own name first, then its phrases; phrases without a word left out."""
    rows = [(f, k, p) for f, ps in (aliases or load_aliases()).items() for k, p in enumerate([f, *ps])]
    if len(rows) > MOST_PHRASES:
        raise ValueError("alias tables are configuration; this one is too large to hold against every question")
    table = spark.createDataFrame(rows, "field string, ord int, phrase string")
    return table.select("field", "ord", "phrase", normalize(F.col("phrase")).alias("p_norm"), question_words(F.col("phrase")).alias("p_words")).where(F.size("p_words") > 0)


def score_phrases(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """questions(question_id, question) with every phrase: score and reason. The phrase table's size is checked, so it is broadcast."""
    q = questions.select("question_id", normalize(F.col("question")).alias("q_norm"), question_words(F.col("question")).alias("q_words"))
    pairs = q.join(F.broadcast(phrases))
    qs, ps = F.array_distinct("q_words"), F.array_distinct("p_words")
    shared = F.size(F.array_intersect("q_words", "p_words"))
    overlap = 0.65 * (shared / F.size(ps)) + 0.35 * (shared / F.greatest(F.size(qs), F.lit(1)))
    overlap = F.when((F.size(ps) == 1) & (F.size(qs) > 1), overlap * 0.70).otherwise(overlap)

    def outcome(score, reason):
        return F.struct(F.lit(score).cast("double").alias("score") if isinstance(score, float) else score.cast("double").alias("score"), F.lit(reason).alias("reason"))

    judged = (
        F.when(F.col("p_norm") == F.col("q_norm"), outcome(1.0, "exact_question_match"))
        .when(contains_sequence(F.col("q_words"), F.col("p_words")), outcome(F.lit(0.90) + F.least(F.size(ps), F.lit(5)) * F.lit(0.01), "alias_phrase_in_question"))
        .when(contains_sequence(F.col("p_words"), F.col("q_words")), outcome(0.75, "question_phrase_in_alias"))
        .otherwise(outcome(overlap, "token_overlap"))
    )
    return pairs.select("question_id", "field", "ord", "phrase", F.size("p_words").alias("phrase_words"), F.size("q_words").alias("question_words"), judged.alias("j")).select("*", "j.score", "j.reason").drop("j")


def resolve(questions: DataFrame, phrases: DataFrame, top: int = RESOLVE_TOP, threshold: float = RESOLVE_THRESHOLD) -> DataFrame:
    """(question_id, rank, field, score, matched_alias, reason, ...): each field by its best phrase, the first of equals."""
    scored = score_phrases(questions, phrases)
    best = F.max_by(F.struct("score", "phrase", "reason", "phrase_words", "question_words"), F.struct("score", -F.col("ord"))).alias("b")
    fields = scored.groupBy("question_id", "field").agg(best).where(F.col("b.score") >= threshold)
    kept = fields.select("question_id", "field", F.bround("b.score", 4).alias("score"), F.col("b.phrase").alias("matched_alias"), F.col("b.reason").alias("reason"), "b.phrase_words", "b.question_words")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "field")).cast("long")
    return kept.withColumn("rank", rank).where(F.col("rank") <= top)


def resolve_one(spark: SparkSession, question: str, aliases: dict[str, list[str]] | None = None, top: int = RESOLVE_TOP, threshold: float = RESOLVE_THRESHOLD) -> list[dict]:
    """The candidates for one question, best first; at most `top` rows."""
    asked = spark.createDataFrame([(0, question)], "question_id int, question string")
    return [r.asDict() for r in resolve(asked, phrase_table(spark, aliases), top, threshold).orderBy("rank").collect()]
