"""SimHash near-duplicates by a binary-trie self-join.

Every distinct fingerprint is a leaf of a binary trie. Two trie nodes of equal depth are walked down
together; the walk adds up the bits in which their paths differ and drops a pair of nodes once the sum
passes the error budget. To spread the walk over tasks, a fingerprint enters one trie for each choice
of `blocks - budget` whole blocks out of `blocks`: two fingerprints within the budget agree in at least
that many blocks, so they share the node at that depth in one of these tries. A task holds some of
these subtrees and returns a spanning forest of the links it finds, never all pairs of a dense cluster.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_EDGES, components, free_name, materialize, small_batches

WIDTH = 3
SEED = 42
BITS = 64
BLOCKS = 4
BUDGET = 2
SUBTREE_ROWS = 60_000
PAIRS_AT_ONCE = 1 << 18  # node pairs that are walked down together
HOT_SHARE = 10_000  # fingerprints with over one in so many rows are joined back by broadcast, so there are fewer of them than this


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text; zero for null or a text without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def trie_link_batches(keys: np.ndarray, depth: int, budget: int):
    """Index pairs, in batches, of the sorted distinct keys that agree in the first `depth` bits and differ in at most `budget`.

    Node pairs are walked down PAIRS_AT_ONCE at a time, the deepest first, so what waits is bounded by the
    depth of the trie and not by the number of links.
    """
    if len(keys) < 2:
        return
    top = keys >> np.uint64(BITS - depth) if depth else np.zeros(len(keys), np.uint64)
    cut = np.flatnonzero(top[1:] != top[:-1]) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(keys)]
    many = hi - lo > 1
    waiting = [(depth, np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64)]))]
    zeros = {}
    while waiting:
        d, pairs = waiting.pop()
        if not pairs.shape[1]:
            continue
        if d == BITS:
            yield pairs[0], pairs[2]
            continue
        if pairs.shape[1] > PAIRS_AT_ONCE:
            waiting += [(d, pairs[:, PAIRS_AT_ONCE:]), (d, pairs[:, :PAIRS_AT_ONCE])]
            continue
        if d not in zeros:
            zeros[d] = np.r_[0, np.cumsum(((keys >> np.uint64(BITS - 1 - d)) & np.uint64(1)) == 0)]
        z = zeros[d]
        a, b, c, e, err = pairs
        m, k = a + z[b] - z[a], c + z[e] - z[c]
        own = a == c
        grown = [np.stack([a, m, c, k, err]), np.stack([m, b, k, e, err]), np.stack([a, m, k, e, err + 1]), np.stack([m, b, c, k, err + 1])[:, ~own]]
        pairs = np.concatenate(grown, axis=1)
        a, b, c, e, err = pairs
        waiting.append((d + 1, pairs[:, (b > a) & (e > c) & (err <= budget) & ~((a == c) & (b - a == 1))]))


def trie_links(keys: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All batches together."""
    found = [(np.empty(0, np.int64),) * 2, *trie_link_batches(keys, depth, budget)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _subtrees(depth: int, budget: int):
    def run(t: pa.Table) -> pa.Table:
        order = t.column("perm").to_numpy()
        key = t.column("key").to_numpy().view(np.uint64)
        leaf = t.column("fp").to_numpy()
        left, right = [], []
        for p in np.unique(order):
            at = np.flatnonzero(order == p)
            at = at[np.argsort(key[at], kind="stable")]
            root: dict[int, int] = {}

            def find(x):
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            for i, j in trie_link_batches(key[at], depth, budget):
                for x, y in zip(leaf[at[i]].tolist(), leaf[at[j]].tolist(), strict=True):
                    a, b = find(x), find(y)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        left.append(x)
                        right.append(y)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def simhash_classes(docs: DataFrame, blocks: int = BLOCKS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Null or empty text: fingerprint zero, linked like any other. Very long texts are fingerprinted whole.
    Repeated rows each come back; rows with equal fingerprints are one trie leaf. Rows with a null doc_id
    link and bridge like others, but name no class: component_id is the smallest non-null doc_id of the
    class, or null where there is none. An empty table gives an empty result. Other columns of docs are
    not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = BITS // blocks
    fps = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    leaves = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "leaves")
    n, rows = leaves.agg(F.count("*"), F.sum("n")).first()
    fp = F.col("fp")
    tries = []
    for p, lead in enumerate(combinations(range(blocks), blocks - budget)):
        key = F.lit(0).cast("long")
        for k in (*lead, *(k for k in range(blocks) if k not in lead)):
            part = F.shiftrightunsigned(fp, BITS - size * (k + 1)).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            key = F.shiftleft(key, size).bitwiseOR(part)
        tries.append(F.struct(F.lit(p).alias("perm"), key.alias("key")))
    parts = max(1, -(-n * len(tries) // SUBTREE_ROWS))
    depth = size * (blocks - budget)
    spread = (
        leaves.select("fp", F.explode(F.array(*tries)).alias("t")).select("fp", "t.perm", "t.key")
        .withColumn("subtree", F.pmod(F.xxhash64("perm", F.shiftrightunsigned("key", BITS - depth)), F.lit(parts)))
    )
    links = spread.groupBy("subtree").applyInArrow(_subtrees(depth, budget), "a long, b long")
    near = components(links, "simhash-links")  # by fingerprint
    members = materialize(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()), "simhash-members")
    least = members.join(leaves, members.node == leaves.fp).groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = members.count()
    least = F.broadcast(least) if linked <= BROADCAST_EDGES else least
    told = members.join(least, "root").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    told = F.broadcast(told) if linked <= BROADCAST_EDGES else told
    named = materialize(leaves.join(told, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")), "simhash-named")
    # The copies of a text meet neither in a shuffle by fingerprint nor in one task: hot ones are few and broadcast.
    hot = F.col("n") * HOT_SHARE > F.lit(rows or 0)
    often, seldom = F.broadcast(named.where(hot).drop("n")), named.where(~hot).drop("n")
    both = fps.join(often, "fp").unionByName(fps.join(often.select("fp"), "fp", "left_anti").join(seldom, "fp"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest doc_id of their class; columns of docs as they are, whatever they are called.

    Rows with a null doc_id stay: they cannot be told apart. Of repeated rows with one doc_id all stay. An
    empty table gives an empty result.
    """
    classes = simhash_classes(docs)
    kept = free_name(docs, "_kept")
    first = classes.where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    rows = docs.join(first, F.col("doc_id") == F.col(kept), "left")
    return rows.where(F.col(kept).isNotNull() | F.col("doc_id").isNull()).drop(kept)
