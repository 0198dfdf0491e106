"""The line labels themselves: against all paths, and on documents with boilerplate planted among content."""

import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlantern.llm import quality


@pytest.fixture(scope="module")
def tables(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{tiny}/labels.parquet")


@pytest.fixture(scope="module")
def chain(tables):
    return quality.fit(*tables)


def best_share(text, chain):
    """Content share of the best of all labellings, of equals the one with content at the last line where they differ."""
    lines, texts = quality.lines_of(text or "")
    if not lines:
        return 0.0
    u = quality.line_features(lines, texts) @ chain.unary
    paths = itertools.product((0, 1), repeat=len(lines))
    score = lambda p: sum(u[i, y] for i, y in enumerate(p)) + sum(chain.pair[a, b] for a, b in itertools.pairwise(p))
    best = max(paths, key=lambda p: (round(score(p), 9), p[::-1]))
    return sum(len(t) for t, y in zip(texts, best, strict=True) if y) / sum(map(len, texts))


def test_kept_equals_all_paths(spark, tables, chain):
    docs = [(r.doc_id, r.text) for r in tables[0].collect()]
    rng = random.Random(1)
    small = [(k, "\n".join(rng.sample(rng.choice(docs)[1].split("\n") + rng.choice(docs)[1].split("\n"), 2)[:9] * rng.randint(1, 4))) for k in range(120)]
    small += [(d, t) for d, t in docs if t is None or t.count("\n") < 9]
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(spark.createDataFrame(small, "doc_id long, text string"), tables[1], chain=chain).collect()}
    for d, t in small:
        base, share = brute.quality(t), best_share(t, chain)
        r = got[d, base[0]]
        assert abs(r.content_share - share) < 1e-9 and r.kept == (not base[5] and share >= 0.5)


def test_planted_boilerplate_lines_are_found(tables, chain):
    """Runs of junk lines inside good documents, and of good lines inside bad ones: recall and precision by line."""
    told = {r.doc_id: r.quality for r in tables[1].collect()}
    lines = {0: [], 1: []}
    for r in tables[0].collect():
        if r.doc_id in told:
            lines[told[r.doc_id]] += [x for x in (r.text or "").split("\n") if len(quality.ascii_words(x)) > 3]
    rng, hit, mixed = random.Random(2), np.zeros((2, 2), int), 0
    for _ in range(60):
        gold, text = [], []
        for turn in range(rng.randint(2, 4)):
            y = turn % 2
            part = rng.sample(lines[y], rng.randint(2, 8))
            text += part
            gold += [y] * len(part)
        label = chain.decode(quality.line_features(*quality.lines_of("\n".join(text))))
        mixed += 0 < label.sum() < len(label)
        np.add.at(hit, (gold, label), 1)
    recall, precision = hit[0, 0] / hit[0].sum(), hit[0, 0] / hit[:, 0].sum()
    assert mixed >= 57 and recall >= 0.9 and precision >= 0.9, (mixed, recall, precision)


def test_the_sample_is_bounded_and_reads_long_texts(spark, tables):
    one = tables[0].limit(1).crossJoin(spark.range(30_000).select()).withColumn("doc_id", F.lit(1).cast("long"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    assert quality.sample(one, labels).count() == 1, "copies of a row count once"
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert quality.sample(many, labels, 100).count() == 100
    long = spark.createDataFrame([(1, "A!! B## C!! D$$\n" * 3000), (2, "a word and another one, said plainly.\n" * 3000)], "doc_id long, text string")
    fitted = quality.fit(long, labels)
    assert fitted.decode(quality.line_features(*quality.lines_of("A!! B## C!! D$$\n" * 3 + "a word and another one, said plainly.\n" * 4))).tolist() == [0] * 3 + [1] * 4
