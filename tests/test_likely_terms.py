"""Terms that cannot match stay in their documents; those that match all leave them."""

import random

from pyspark.sql import functions as F

from eventlantern.functions.analysis import likely_terms
from eventlantern.operators.documents import text_documents
from eventlantern.operators.search import analyse, score_terms, scored_terms, vocabulary

ASKED = ("lisense", "exmple", "host", "ws", "abc", "größe", "ws-12.corp.exmple.org", "a" * 70)


def edited(r: random.Random, word: str) -> str:
    for _ in range(r.randint(0, 4)):
        k = r.randint(0, len(word))
        word = r.choice((word[:k] + r.choice("abesé-.1") + word[k:], word[:k] + word[k + 1:], word[:k] + r.choice("lxoß") + word[k + 1:], word[:k], word + "x"))
    return word


def test_no_term_that_matches_is_left_behind(spark):
    r = random.Random(5)
    rows = [(n, [edited(r, r.choice(ASKED)) for _ in range(r.randint(0, 60))]) for n in range(400)] + [(400, []), (401, ["", "other", "other"])]
    docs = spark.createDataFrame(rows, "n long, tokens array<string>").repartition(3)
    for asked in ([q] for q in ASKED):
        told = lambda terms: {tuple(x) for x in score_terms(terms, asked, ("exact", "partial", "fuzzy")).collect()}  # noqa: B023, E731
        want = told(vocabulary(docs))
        likely = docs.select("n", F.explode(likely_terms(F.col("tokens"), asked)).alias("term"))
        assert told(likely.groupBy("term").agg(F.count("*").alias("df"))) == want and (want or len(asked[0]) < 4)


def test_few_of_a_corpus_are_likely(spark, tiny):
    docs = text_documents(spark.read.parquet(f"{tiny}/documents.parquet"), "doc_id", F.col("text"), "source")
    tokens = analyse("lisense aphache versoin").tokens
    likely = docs.select(F.explode(likely_terms(F.col("tokens"), tokens)).alias("term"))
    assert likely.count() * 20 < vocabulary(docs).agg(F.sum("df")).first()[0]
    assert {tuple(x) for x in scored_terms(docs, tokens).collect()} == {tuple(x) for x in score_terms(vocabulary(docs), tokens).collect()}
    assert scored_terms(docs, tokens)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
