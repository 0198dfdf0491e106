"""Near copies by exact word-shingle Jaccard: MinHash bands propose, whole candidate groups are compared.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of
`threshold`. Texts that share a band of ROWS minima go to one candidate group (a component over shared
bands), so a pair at 0.8 is proposed with a probability of 1 - (1 - 0.8^4)^24, about 0.999997. A group is
cut into chunks by hash. Each chunk is compared with itself and with the group's pivot, its smallest
member; texts that are linked to the pivot, directly or through others, are one class already and need
not be compared with each other. Only the rest is then compared with the whole group, chunk by chunk. So
a group of m texts around one original costs m rows, and r texts apart from it 2 m r / CHUNK_ROWS more. A
unit of work counts its pairs through an inverted index and returns a spanning forest of the links it
finds, never all pairs of a cluster.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, materialize, small_batches

WIDTH = 5
THRESHOLD = 0.8
SEED = 42
BANDS = 24
ROWS = 4
CHUNK_ROWS = 256
CHUNK_BYTES = 4 << 20
TASK_ROWS = 2000
TASK_BYTES = 16 << 20
_FACTORS = (np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles; of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)), strict=False)) if len(words) >= WIDTH else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - WIDTH + 1)))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 512):
        low = np.minimum(low, (own[at : at + 512] * _FACTORS).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(low.reshape(BANDS, ROWS))]


def _sketches(batches):
    for b in batches:
        found = [(k, bands(own)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(own := shingles(t))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["node", "bands"])


def near_pairs(sets: list[np.ndarray], side: np.ndarray, threshold: float):
    """Index pairs x < y at the threshold. If side has two values, only pairs across them."""
    size = np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    holders = owner[np.argsort(word, kind="stable")]
    n = np.bincount(word)
    first = np.cumsum(n) - n
    ends = np.cumsum(size)
    across = len(np.unique(side)) > 1
    for x in range(len(sets)):
        w = word[ends[x] - size[x] : ends[x]]
        w = w[n[w] > 1]
        if not len(w):
            continue
        m = n[w]
        at = np.repeat(first[w] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        shared = np.bincount(holders[at], minlength=len(sets))
        near = shared * (1 + threshold) >= threshold * (size + size[x]) - 1e-9
        near[: x + 1] = False
        if across:
            near &= side != side[x]
        for y in np.flatnonzero(near).tolist():
            yield x, y


def _units(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        group, i, j, side, node = (t.column(c).to_numpy() for c in ("group", "i", "j", "side", "node"))
        text = t.column("text")
        order = np.lexsort((j, i, group))
        g = np.stack([group[order], i[order], j[order]])
        cuts = np.r_[0, np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1, len(order)] if len(order) else [0]
        left, right = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            root = list(range(len(at)))

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in near_pairs([shingles(text[k].as_py()) for k in at.tolist()], side[at], threshold):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    left.append(int(node[at[x]]))
                    right.append(int(node[at[y]]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) for every text with a near copy of other text; node is its xxhash64, root names its class."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("doc_id is not null and text is not null").select(F.xxhash64("text").alias("node"), "text")
    sketches = materialize(rows.mapInArrow(_sketches, "node long, bands array<long>"), "bands")
    keys = sketches.select("node", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("band", "hub")
    shared = keys.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = components(shared, "near-candidates")
    members = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).distinct()
    texts = materialize(rows.join(materialize(members, "near-members"), "node").dropDuplicates(["node"]).select("node", F.col("root").alias("group"), "text"), "near-texts")
    size = F.octet_length("text")

    def chunks(rows: DataFrame) -> DataFrame:
        return rows.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum(size) / CHUNK_BYTES)).cast("int").alias("chunks"))

    def links(units: DataFrame, name: str) -> DataFrame:
        units = materialize(units.select("group", "i", "j", "side", "node", "text"), name)
        total = units.agg(F.count("*"), F.sum(size)).first()
        parts = max(1, (total[0] or 0) // TASK_ROWS, (total[1] or 0) // TASK_BYTES)
        units = units.withColumn("unit", F.pmod(F.xxhash64("group", "i", "j"), F.lit(parts)))
        return units.groupBy("unit").applyInArrow(_units(threshold), "a long, b long")

    def sides(k: int) -> Column:
        return F.lit(k).alias("side")

    def deal(rows: DataFrame, parts: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")

    groups = materialize(chunks(texts), "near-groups")
    cut = texts.join(groups, "group").withColumn("i", deal(texts, "chunks", 1))
    pivots = cut.where("node = group").select("group", "node", "text", F.col("i").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i")).where("i <> own")
    first = cut.select("group", "i", "node", "text").unionByName(pivots.select("group", "i", "node", "text"))
    near = materialize(links(first.select("group", "i", F.lit(-1).alias("j"), sides(0), "node", "text"), "near-units"), "near-links-one")
    told = _named(components(near, "near-links"))
    classes = texts.select("group", "node").join(told, "node", "left").select("group", "node", F.coalesce("root", "node").alias("class"))
    classes = materialize(classes, "near-classes-one")
    main = classes.where("node = group").select("group", F.col("class").alias("main"))
    apart = materialize(classes.join(main, "group").where("class <> main").select("node"), "near-apart")
    if not apart.isEmpty():
        rest = texts.join(apart, "node", "left_semi")
        many = materialize(chunks(rest).select("group", F.col("chunks").alias("others")), "near-others")
        some = rest.join(many, "group").join(groups, "group").select("group", deal(rest, "others", 2).alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), sides(0), "node", "text")
        every = cut.join(many, "group").select("group", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), sides(1), "node", "text")
        near = near.unionByName(links(some.unionByName(every), "near-units"))
        told = _named(components(near, "near-links"))
    return told


def _named(roots: DataFrame) -> DataFrame:
    """Every node of a class with its root, the root among them."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of what simhash.keep_one keeps, the smallest doc_id of every class of near copies; columns of docs as they are.

    Rows with a null doc_id stay and remove no other. Of repeated rows with one doc_id all stay. Texts
    without words have no near copy. An empty table gives an empty result; extra columns stay, whatever
    they are called.
    """
    docs = materialize(simhash.keep_one(docs), "near-docs")
    classes = materialize(near_classes(docs, threshold), "near-classes")
    held = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("node")).join(classes, "node").select("doc_id", "node", "root").distinct()
    held = materialize(held, "near-held")
    first = held.groupBy("root").agg(F.min("doc_id").alias("kept"))
    gone = materialize(held.join(first, "root").where("doc_id <> kept").select(F.col("doc_id").alias("_gone"), F.col("node").alias("_node")), "near-gone")
    return docs.join(gone, (docs.doc_id == gone._gone) & (F.xxhash64(docs.text) == gone._node), "left_anti")
