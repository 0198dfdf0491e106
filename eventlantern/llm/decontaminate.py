"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is a set of five-word shingles, and so is a text. A text far longer than an item has a Jaccard
similarity with it near zero however much of it it holds, so a text is indexed as overlapping segments
whose length depends on the size class of the items sought: within a class the ratio of sizes, and with
it the loss of the sketch, is bounded. A sketch is a one-permutation MinHash: each shingle hash falls in
a bin and a bin keeps its least. An item and a segment are a candidate pair if they agree in one bin
(one band for each bin). There are twice as many bins as shingles in a segment, so a shared shingle is
the least of its bin with a probability of 0.79, and a pair with k shared shingles is missed with one of
0.21 to the power k (1e-7 for ten). Items with fewer than FEW shingles need no
sketch: all their shingles are looked up. Each candidate is then counted over the whole text, by the
shingles' own words.
"""

from __future__ import annotations

from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH = 5
THRESHOLD = 0.8
FEW = 10
# Size classes of items: the largest number of shingles, and how many bits choose a bin. A segment has
# half as many shingles as there are bins; segments overlap by half, so any item up to the size of its
# class that stands in one piece lies whole in some segment.
CLASSES = ((64, 9), (512, 12), (1 << 62, 15))
ITEMS_AT_ONCE = 20_000  # items are held against all texts in blocks of this many
ITEM_WORDS_AT_ONCE = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Runs of `width` words; all words together where there are fewer."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` word hashes; the same on every machine."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Items:
    """One block of items, ready to be held against texts. rows: (item_id, text)."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = THRESHOLD, width: int = WIDTH):
        self.threshold, self.width = threshold, width
        self.ids, self.sets = [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # words in the item -> hash -> items, for items below the width
        looked: dict[int, set[int]] = {}  # hash -> items, for small items
        sketches: list[dict[int, set[int]]] = [{} for _ in CLASSES]
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(frozenset(shingles_of(words, width)))
            h = word_hashes(words)
            if len(words) < width:
                self.short.setdefault(len(words), {}).setdefault(int(shingle_hashes(h, len(words))[0]), []).append(k)
                continue
            own = np.unique(shingle_hashes(h, width))
            if len(own) < FEW:
                for x in own.tolist():
                    looked.setdefault(x, set()).add(k)
                continue
            size = next(c for c, (most, _) in enumerate(CLASSES) if len(own) <= most)
            bins = own >> np.uint64(64 - CLASSES[size][1])
            first = np.r_[True, bins[1:] != bins[:-1]]  # sorted, so the first of a bin is its least
            for x in own[first].tolist():
                sketches[size].setdefault(x, set()).add(k)
        self.looked = self._table(looked)
        self.sketches = [self._table(s) for s in sketches]

    @staticmethod
    def _table(of: dict[int, set[int]]):
        keys = np.array(sorted(of), np.uint64)
        low = np.zeros(1 << 18, bool)
        low[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        return keys, low, of

    def _hits(self, h: np.ndarray, table) -> np.ndarray:
        """Positions of h that are keys of the table."""
        keys, low, _ = table
        if not len(keys):
            return np.empty(0, np.int64)
        maybe = np.flatnonzero(low[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        return maybe[keys[at] == h[maybe]]

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items whose sketch agrees in some bin with that of some segment of a text with shingle hashes h."""
        found: set[int] = set()
        for x in h[self._hits(h, self.looked)].tolist():
            found |= self.looked[2][x]
        for (_, bits), table in zip(CLASSES, self.sketches, strict=True):
            step, shift = 1 << (bits - 2), np.uint64(64 - bits)
            for at in self._hits(h, table).tolist():
                x = h[at]
                own = table[2][int(x)]
                if own <= found:
                    continue
                for seg in {max(0, at // step - 1), at // step}:
                    part = h[seg * step : (seg + 2) * step]
                    if part[(part >> shift) == (x >> shift)].min() == x:  # the least of its bin in this segment
                        found |= own
                        break
        return found

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item_id, shared, size, containment) of every item contained in the text to the threshold."""
        words = words_of(text)
        if not words:
            return []
        wh = word_hashes(words)
        found = self.candidates(shingle_hashes(wh, self.width)) if len(words) >= self.width else set()
        out = []
        if found:
            own = set(shingles_of(words, self.width))
            for k in found:
                shared = len(self.sets[k] & own)
                if shared >= ceil(self.threshold * len(self.sets[k]) - 1e-9):
                    out.append((self.ids[k], shared, len(self.sets[k]), shared / len(self.sets[k])))
        for n, table in self.short.items():
            hits = set(shingle_hashes(wh, n).tolist()) & table.keys()
            if hits:
                own = set(shingles_of(words, n))
                out += [(self.ids[k], 1, 1, 1.0) for x in hits for k in table[x] if next(iter(self.sets[k])) in own]
        return sorted(out, key=lambda m: (m[0] is not None, m[0]))


def item_blocks(benchmark: DataFrame, items: int = ITEMS_AT_ONCE, words: int = ITEM_WORDS_AT_ONCE):
    """benchmark(item_id, text) in bounded blocks of (item_id, text) rows, streamed through the driver."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").dropDuplicates().toLocalIterator():
        if r[1] is None:
            continue
        block.append((r[0], r[1]))
        size += r[1].count(" ") + 1
        if len(block) >= items or size >= words:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCHES = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """MATCHES's columns: a row for each row of docs(doc_id, text) and item it contains to the threshold.

    Shingles are distinct runs of five words; an item with fewer words is one shingle. Null texts and
    items, and items without a word, match nothing. Repeated benchmark rows count once, repeated
    documents each come back. Texts are searched whole, however long. Either table may be empty. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(block, threshold))

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                found = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in items.matches(t)]
                cols = list(zip(*found, strict=True)) if found else list(repeat([], 5))
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        part = rows.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return rows.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in MATCHES.split(", ")[1:])]) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that contain no item to the threshold; columns as they are, whatever they are called.

    Null and empty texts contain nothing and stay, whatever their doc_id; repeated rows share their fate. Texts
    are searched whole, however long. Either table may be empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(block, threshold))

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                yield b.filter(pa.array([not items.matches(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
