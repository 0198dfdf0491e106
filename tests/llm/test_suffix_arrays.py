"""Prefix-free parsing: suffix ranks, windows and whole tables against brute force, on texts that are hard on hashes."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from eventlantern.llm import repeats


def thue_morse(n):
    """Repeats of every length whose polynomial hashes modulo powers of two collide."""
    x, y = b"a", b"b"
    for _ in range(n):
        x, y = x + y, y + x
    return x + y + x


def test_suffix_ranks_are_the_order_of_suffixes():
    rng = random.Random(1)
    for _ in range(50):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        size = np.array([len(t) for t in texts])
        ends = np.repeat(np.cumsum(size), size)
        got = repeats.suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), ends, 100)
        suffixes = [t[i:] for t in texts for i in range(len(t))]
        order = {s: k + 1 for k, s in enumerate(sorted(set(suffixes)))}
        assert got.tolist() == [order[s] for s in suffixes]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh ", bytes(range(256))])
def test_windows_that_stand_earlier(alphabet):
    rng = random.Random(len(alphabet))
    for trial in range(25):
        base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(3)]
        texts = [b"".join(b[(i := rng.randint(0, len(b))) : rng.randint(i, len(b))] for b in rng.choices(base, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        texts += [thue_morse(9)] if trial % 7 == 0 else []
        seen, want = set(), []
        for t in texts:
            mine = []
            for p in range(len(t) - 99):
                mine.append(t[p : p + 100] in seen)
                seen.add(t[p : p + 100])
            want.append(mine)
        assert [g.tolist() for g in repeats.stands_earlier(texts)] == want


def test_whole_tables_in_small_blocks_and_buckets(spark):
    """Passages across blocks and buckets, low entropy, one doc_id and no doc_id for many rows."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(90, 400))) for _ in range(8)] + ["x" * 700, "ab" * 300, thue_morse(8).decode(), "xy" * 90 + "z" * 200]
    docs = []
    for k in range(150):
        own = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(0, 300)))
        text = own + "".join(p[rng.randint(0, 60) :] for p in rng.choices(passages, k=rng.randint(0, 3)))
        docs.append((k, text))
    docs += [(500, docs[3][1])] * 3 + [(600 + k, passages[8]) for k in range(20)] + [(None, "short"), (700, None), (701, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, block_no long, h string")
    got = Counter(tuple(r) for r in repeats.remove_repeats(df, 4000, 3000).collect())
    assert got == brute.repeats(docs) and sum(r[2] > 0 for r in got) > 60


def test_rows_of_one_id_spread_and_the_table_goes_when_a_step_fails(spark, monkeypatch):
    rows = [(None, f"{k % 50} " + "and the same passage in every row of this table " * 4) for k in range(400)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 2000, 2000).collect()
    text = {r.kept_sha256 for r in got}
    assert len(got) == 400 and sum(r.n_removed == 0 for r in got) <= 1 and len(text) <= 52
    before = spark.catalog.listTables()
    monkeypatch.setattr(repeats, "ROUNDS", (("no_such_step", "x", None),))
    with pytest.raises(Exception):
        repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [t.name for t in spark.catalog.listTables()] == [t.name for t in before]
