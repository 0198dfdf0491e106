"""Rows without a doc_id as links and bridges, names that clash, hot fingerprints."""

import random

import brute
from collections import Counter

from eventlantern.llm import simhash

SCHEMA = "doc_id long, text string, _kept long, FP string, root long"


def near_texts(seed, n=80):
    """Texts that drift one word at a time, so that some are bridges between others."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    out = []
    for k in range(n):
        out.append(" ".join(words))
        words[rng.randrange(400)] = f"v{k}"
    return out


def test_rows_without_an_id_link_and_bridge(spark):
    rng = random.Random(8)
    docs = [(None if rng.random() < 0.6 else 1000 - k, t) for s in range(3) for k, t in enumerate(near_texts(s))] + [(None, None), (9, ""), (9, "")]
    got = Counter(tuple(r) for r in simhash.simhash_classes(spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], SCHEMA)).collect())
    want = brute.classes(docs)
    assert got == want
    bridged = [f for f in {f for d, f, _ in want if d is None} if sum((int(f, 16) ^ int(g, 16)).bit_count() <= 2 for d, g, _ in want if d is not None) > 1]
    assert bridged, "the case at hand: a row without an id between two with one"


def test_no_id_at_all_and_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 5)
    docs = [(None, t) for t in near_texts(1, 20)] + [(k, "one and the same") for k in range(50, 90)]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], SCHEMA)
    assert Counter(tuple(r) for r in simhash.simhash_classes(df).collect()) == brute.classes(docs)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter({None: 20, 50: 1})
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_batches_of_node_pairs_lose_nothing(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    keys = np.unique(base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (6, 60)).astype(np.uint64)))
    whole = set(zip(*(x.tolist() for x in simhash.trie_links(keys, 0, 2)), strict=True))
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 7)
    assert set(zip(*(x.tolist() for x in simhash.trie_links(keys, 0, 2)), strict=True)) == whole and len(whole) > 1000
