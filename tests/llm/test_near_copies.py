"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random

import brute
import numpy as np

import corpus_pipeline
from eventlantern.llm import nearcopies
from eventlantern.llm.common import table


def plain_classes(docs, threshold=0.8):
    """doc_id -> smallest doc_id of its component over pairs with Jaccard >= threshold, by all pairs."""
    own = [set(brute.shingles(t, 5)) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(own[i] & own[j])
            if n and n >= threshold * (len(own[i]) + len(own[j]) - n) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def edited(words, rng, share):
    out = list(words)
    for k in rng.sample(range(len(out)), round(share * len(out))):
        out[k] = "edit" + str(rng.randrange(10**6))
    return " ".join(out)


def test_edited_copies_are_dropped(spark, tiny):
    """Of each pair at 0.8 one goes; SimHash within two bits finds none of these."""
    rng = random.Random(1)
    docs = []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 600))]
        docs.append((10 * k, " ".join(words)))
        docs += [(10 * k + i, edited(words, rng, s)) for i, s in ((1, 0.01), (2, 0.02), (3, 0.1))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, tiny).collect()}
    classes = plain_classes(docs)
    assert got == {d for d, c in classes.items() if d == c} and 60 <= len(got) < 180


def test_stage_on_the_tiny_table(spark, tiny):
    df = table(spark, tiny, "documents").where("text is not null")
    got = {r.doc_id for r in nearcopies.keep_one(df).collect()}
    docs = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    first = sorted({c for _, _, c in brute.classes(list(docs.items()))})
    want = {d for d, c in plain_classes([(d, docs[d]) for d in first]).items() if d == c}
    assert got == want and len(want) < len(first)


def test_units_across_chunks(spark, monkeypatch):
    """A group of several chunks gives the same classes; ids that are null or repeated stay."""
    monkeypatch.setattr(nearcopies, "CHUNK_ROWS", 3)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    docs = [(k, edited(words, rng, 0.02)) for k in range(40)]
    more = [(None, docs[0][1]), (39, docs[39][1]), (50, None), (51, ""), (52, "one two"), (53, "one  two")]
    df = spark.createDataFrame([*docs, *more], "doc_id long, text string")
    got = sorted((r.doc_id for r in nearcopies.keep_one(df).collect()), key=str)
    want = [d for d, c in plain_classes([*docs, (52, "one two")]).items() if d == c]
    assert got == sorted([*want, None, 50, *([39] if 39 in want else [])], key=str)
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def test_near_pairs_are_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(100) < 0.95], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]) for _ in range(30)]
    side = np.arange(30) % 2
    close = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    want = {(x, y) for y in range(30) for x in range(y) if close(sets[x], sets[y])}
    assert set(nearcopies.near_pairs(sets, np.zeros(30), 0.8)) == want and 0 < len(want) < 435
    assert set(nearcopies.near_pairs(sets, side, 0.8)) == {(x, y) for x, y in want if side[x] != side[y]}
