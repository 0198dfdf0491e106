"""Packing to given proportions, against serving token by token."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from test_operators import check_packing

from eventlantern.llm import packing, queries


def served(sizes, weights):
    """Deficit round-robin step by step: each queue's claim grows with its weight, the next token due goes first."""
    order = sorted((Fraction(2 * x + 1, 2 * w), k) for k, (n, w) in enumerate(zip(sizes, weights, strict=True)) for x in range(n))
    return [k for _, k in order]


def test_states_equal_serving_token_by_token():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        sizes, weights = [rng.randint(1, 60) for _ in range(n)], [rng.randint(1, 9) for _ in range(n)]
        order = served(sizes, weights)
        for taken in {0, 1, len(order) // 3, len(order) // 2, len(order) - 1, len(order)}:
            want = [order[:taken].count(k) for k in range(n)]
            assert packing.window_state(sizes, taken, weights) == want
            assert packing.many_window_state(np.array(sizes), taken, np.array(weights)).tolist() == want


@pytest.mark.parametrize("few", [packing.FEW_QUEUES, 2])
def test_windows_hold_given_proportions_until_a_queue_is_dry(spark, monkeypatch, few):
    monkeypatch.setattr(packing, "FEW_QUEUES", few)
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 300))), rng.choice(["hot"] * 6 + ["small", "third", None])) for k in range(900)]
    targets = {"small": 0.5, "hot": 0.25, None: 0.05}
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), queries.tokenizer_path(), 512, targets).collect()
    encode = lambda x, t=packing.Encoder(queries.tokenizer_path()).whole: t.encode(x, add_special_tokens=False).ids
    check_packing(pieces, [(d, t) for d, t, _ in rows], encode, 512)
    source, held, left = {d: s for d, _, s in rows}, defaultdict(Counter), Counter()
    for r in pieces:
        held[r.sequence_id][source[r.doc_id]] += r.length
        left[source[r.doc_id]] += r.length
    share, seen = {"small": 0.5, "hot": 0.25, None: 0.05, "third": 0.2}, 0
    for s in sorted(held):
        wet = {q for q in share if left[q] >= 512 * share[q] + 4}
        if wet == set(share):
            assert all(abs(held[s][q] - 512 * w) <= 3 for q, w in share.items()), (s, held[s])
            seen += 1
        elif wet == {"hot"}:
            assert held[s]["hot"] >= 250
        left -= held[s]
    assert seen >= 10


def test_targets_that_cannot_be_met_are_refused():
    for bad in ({"a": 0.0}, {"a": 1.5}, {"a": 0.6, "b": 0.6}, {"a": 1.0}):
        with pytest.raises(ValueError):
            packing.queue_weights({"=a": 5, "=b": 5, "=c": 1}, bad)
    assert packing.queue_weights({"=a": 5, "": 5}, {"a": 0.25}) == {"=a": 250_000_000, "": 750_000_000}
