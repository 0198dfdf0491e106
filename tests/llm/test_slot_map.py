"""Sharding against plain loops, and the map over several versions."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from eventlantern.llm import sharding


def virtual_slot(doc_id, text, slots):
    h = 42
    if doc_id is not None:
        h = xxhash.xxh64_intdigest((doc_id & (1 << 64) - 1).to_bytes(8, "little"), h)
    h = xxhash.xxh64_intdigest((text or "").encode(), h)
    return (h - (1 << 64) if h >> 63 else h) % slots


def plain(docs, shards, slots, old=None):
    """(rows of shard_documents as a Counter, map) by plain loops."""
    rows = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), virtual_slot(d, t, slots)) for d, t in docs]
    sizes = [0] * slots
    for _, n, _, v in rows:
        sizes[v] += n
    new = sharding.edit_map(sizes, old or [k % shards for k in range(slots)], shards)
    out, at = [], Counter()
    for d, n, crc, v in sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0], r[2], r[1])):
        out.append((d, n, crc, "bytes", new[v], at[new[v]], None, v))
        at[new[v]] += 1
    return Counter(out), new


def docs_of(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + k, "é" * rng.randrange(1, 400)) for k in range(n)] + [(None, "x"), (None, None), (5, "same"), (5, "same"), (-3, "")]


def got(df):
    return Counter(tuple(r)[:8] for r in df.collect()), {r.map_version for r in df.collect()}


def test_rows_equal_plain_loops(spark):
    docs = docs_of(1, 700)
    rows, _ = got(sharding.shard_documents(spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, shard int, slot int"), 7, 512))
    assert rows == plain(docs, 7, 512)[0]


def test_a_stored_map_is_edited_from_version_to_version(spark, tmp_path):
    path, schema = f"{tmp_path}/map", "doc_id long, text string"
    one, more = docs_of(1, 700), docs_of(2, 300, 700)
    first, version = got(sharding.shard_documents(spark.createDataFrame(one, schema), 7, 512, path))
    want, first_map = plain(one, 7, 512)
    assert first == want and version == {1}
    again, version = got(sharding.shard_documents(spark.createDataFrame(one, schema), 7, 512, path))
    assert again == first and version == {1}, "nothing has to move, so no version is added"
    second, version = got(sharding.shard_documents(spark.createDataFrame(one + more, schema), 7, 512, path))
    want, second_map = plain(one + more, 7, 512, first_map)
    assert second == want and version == {2}
    assert 0 < sum(a != b for a, b in zip(first_map, second_map, strict=True)) < 100
    slot_map = sharding.SlotMap(spark, path, 512)
    assert slot_map.versions() == [0, 1, 2] and slot_map.shards_of(1) == first_map and slot_map.shards_of(2) == second_map
    fewer, _ = got(sharding.shard_documents(spark.createDataFrame(one, schema), 5, 512, path))
    assert {r[4] for r in fewer} == set(range(5))
    with pytest.raises(ValueError):
        sharding.SlotMap(spark, path, 100).shards_of(1)


def test_edits_end_within_the_tolerance_from_the_worst_start():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 5000) for _ in range(8192)]
    new = sharding.edit_map(sizes, [0] * 8192, 24)
    load = defaultdict(int)
    for s, k in zip(sizes, new, strict=True):
        load[k] += s
    assert max(load.values()) - min(load.values()) <= sharding.TOLERANCE * sum(sizes) / 24
