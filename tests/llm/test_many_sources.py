"""Packing of more sources than the plain loops serve."""

import random
from collections import Counter, defaultdict

import numpy as np
from test_operators import check_packing

from eventlantern.llm import packing, queries


def test_many_queues_have_the_same_states():
    rng = random.Random(4)
    for sizes in ([rng.randint(1, 40) for _ in range(300)], [7] * 200, [1, 10**6, *range(1, 90)], [10**12, 10**12 - 1, 3, 3]):
        total = sum(sizes)
        for taken in [0, 1, total - 1, total, total + 5, *(rng.randrange(total) for _ in range(60))]:
            assert packing.many_window_state(np.array(sizes), taken).tolist() == packing.window_state(sizes, taken)


def test_every_window_holds_each_source_at_any_number(spark):
    """A hot source and 1500 small ones, laid out by source: small ones are within two tokens of their share of a window, the hot one within 5 %.

    Small queues of equal size are due at the same instants, so the hot one waits for such a burst.
    """
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(40)), "hot") for k in range(400)]
    docs += [(1000 + k, " ".join(rng.choice("abcdefgh") for _ in range(8 + k % 30)), f"site{k:04}") for k in range(1500)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), queries.tokenizer_path()).collect()
    encode = lambda x, t=packing.Encoder(queries.tokenizer_path()).whole: t.encode(x, add_special_tokens=False).ids
    check_packing(pieces, [(d, t) for d, t, _ in docs], encode)
    source = {d: s for d, _, s in docs}
    held, sizes = defaultdict(Counter), Counter()
    for r in pieces:
        held[r.sequence_id][source[r.doc_id]] += r.length
        sizes[source[r.doc_id]] += r.length
    total = sum(sizes.values())
    full = [s for s in held if (s + 1) * packing.LENGTH <= total]
    assert len(full) > 5 and len(sizes) == 1501
    share = {q: packing.LENGTH * n / total for q, n in sizes.items()}
    assert all(abs(held[s][q] - w) <= (0.05 * w if q == "hot" else 2) for s in full for q, w in share.items())
