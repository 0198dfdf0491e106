"""Letters, the bounded sample, and predictions against a plain version."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlantern.llm import langid


def plain(text, model):
    """Language and score by loops over characters."""
    words, run = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c).startswith("L"):
            run += c
        elif run:
            words.append(run)
            run = ""
    if not words or not model.langs:
        return "und", 0.0
    total = np.zeros(len(model.langs))
    for w in words:
        row = model.words.get(w)
        for n in range(langid.MAX_ORDER, 0, -1):
            if row is None:
                marked = "<" + w + ">"
                seen = [model.grams[n][marked[i : i + n]] for i in range(len(marked) - n + 1) if marked[i : i + n] in model.grams[n]]
                row = np.mean(seen, axis=0) if seen else None
        if row is not None:
            total += row
    share = np.exp(total - total.max())
    return model.langs[int(total.argmax())], float(share.max() / share.sum())


def test_predictions_equal_a_plain_version(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = langid.fit(docs)
    odd = [(-100 - k, t, None) for k, t in enumerate([None, "", "½", "²", "Ⅷ", "①②", "12_3", "a½b", "x² y", "日本語", "İstanbul ẞ", "éa", "été Ⅷ fois"])]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + odd
    got = {r.doc_id: r for r in langid.language_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    for d, t, _ in rows:
        lang, score = plain(t, model)
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-6, (d, t[:40] if t else t)
    assert {d for d, *_ in odd if got[d].lang_pred == "und"} == {-100 - k for k in range(7)}


def test_the_sample_is_bounded_for_each_language(spark):
    hot = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    assert langid.sample(hot).count() == 1
    many = spark.range(5000).select("id", F.concat(F.lit("word "), "id").alias("text"), F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("lang")).withColumnRenamed("id", "doc_id")
    got = {r.lang: r["count"] for r in langid.sample(many, 100).groupBy("lang").count().collect()}
    assert got["often"] == 100 and 60 < got["rare"] <= 100
    long = spark.createDataFrame([(1, "lorem ipsum " * 40_000, "la"), (2, "the house " * 10, "en"), (3, "the house " * 10, "en"), (4, "dolor sit " * 40_000, "la")], "doc_id long, text string, lang string")
    model = langid.fit(long)
    assert "la" in model.langs and model.predict("ipsum dolor")[0] == "la"


def test_keep_known_states_its_cases(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").withColumn("_text", F.lit("x")).withColumn("score", F.lit(1))
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() > 0.9 * docs.count()
    assert langid.keep_known(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        langid.keep_known(docs.withColumn("lang", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        langid.keep_known(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert langid.keep_known(docs.withColumn("text", F.lit("12 ½")).withColumn("lang", F.lit(None).cast("string"))).count() == 0
