"""Exact removal of repeated 100-byte strings by prefix-free parsing.

A rolling hash over TRIGGER bytes marks triggers; a phrase runs from one trigger through the next, so
no phrase is a prefix of another and where a text is cut depends on its content alone.

* Phrases that occur once in the corpus are dropped at once: a window of 100 bytes that holds one whole
  cannot repeat. This is decided by hash; a collision only keeps a window in play that need not be.
* The windows left are dealt by anchor, the least hash of the GRAM-byte strings in a window, which equal
  windows share wherever they stand. Neighbouring windows of one anchor are a region. Equal regions are
  one: all copies but the first repeat. An anchor with one region is settled by that.
* Regions of one anchor that differ are put in order. Their phrases make a dictionary, sorted by letter;
  the texts are parsed into ranks of phrases. A suffix array of the dictionary and one of the parse give
  corpus order: a window is ordered by the rest of its phrase, then by the parse that follows. Neighbours
  in that order are compared byte by byte, so windows count as equal only if they are.

Corpus order is doc_id, then position. Blocks of consecutive documents are the unit of work. A block
sends each phrase and each distinct region once to the bucket it hashes to and gets bits back, so a
passage reaches its bucket once for each block at most, however often it repeats. Messages are as many
as blocks times buckets or as there are keys, whichever is less; sizes of both are parameters. Blocks are
stored bucketed by number, so answers come back without moving text again.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, remove, scratch, small_batches

LENGTH = 100
TRIGGER = 8
ONE_IN = 16  # bytes for each trigger, on average
GRAM = 32
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20  # text for each bucket
ORDER_BYTES = 1 << 19  # regions that are put in order at once; an anchor's are never parted
PART_BYTES = (8 << 20, 128 << 20)  # text for each partition, while they are few and at most
FEW_PARTS, MOST_PARTS = 4096, 100_000

_BASE = 0x9E3779B97F4A7C15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i below n or more."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


class Block:
    """Texts laid end to end: triggers, and hashes of any stretch of bytes."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        x = np.frombuffer(data, np.uint8)
        n = len(x)
        self.bytes, self.off = x, np.r_[0, np.cumsum(sizes)].astype(np.int64)
        up = _power(_BASE, n + 1)
        self.down = _power(pow(_BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[x] * up[:n], out=self.sums[1:])
        if n >= TRIGGER:
            roll = (self.sums[TRIGGER:] - self.sums[:-TRIGGER]) * self.down[: n + 1 - TRIGGER]
            roll ^= roll >> np.uint64(32)
            roll *= _C1
            t = np.flatnonzero(roll >> np.uint64(32) < np.uint64((1 << 32) // ONE_IN))
        else:
            t = np.empty(0, np.int64)
        doc = np.searchsorted(self.off, t, "right") - 1
        whole = t + TRIGGER <= self.off[doc + 1]
        self.trig, self.doc = t[whole], doc[whole]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _C2)

    def phrases(self) -> np.ndarray:
        """A hash for each pair of neighbouring triggers; those across texts are not used later."""
        return self.hash(self.trig[:-1], self.trig[1:] + TRIGGER) if len(self.trig) > 1 else np.empty(0, np.uint64)

    def may_repeat(self, repeated: np.ndarray) -> np.ndarray:
        """For each byte, whether the window that starts there stays in play; repeated: for each phrase.

        Between two cuts, where a trigger leaves or enters the window, all windows hold the same phrases.
        """
        t, start, end = self.trig, self.off[:-1], self.off[1:]
        last = end - LENGTH
        long = last >= start
        cut = np.concatenate([start[long], t + 1, t - (LENGTH - TRIGGER)])
        of = np.concatenate([np.flatnonzero(long), self.doc, self.doc])
        ok = (cut >= start[of]) & (cut <= last[of])
        cut, at = np.unique(cut[ok], return_index=True)
        of = of[ok][at]
        change = np.zeros(len(self.bytes) + 1, np.int32)
        if len(cut):
            hi = np.minimum(np.r_[cut[1:] - 1, np.iinfo(np.int64).max], last[of])
            first = np.searchsorted(t, cut)
            final = np.searchsorted(t, cut + (LENGTH - TRIGGER), "right") - 1
            once = np.r_[0, np.cumsum(~repeated)]
            top = len(once) - 1
            may = (final < first) | (once[np.clip(final, 0, top)] == once[np.clip(first, 0, top)])
            np.add.at(change, cut[may], 1)
            np.add.at(change, hi[may] + 1, -1)
        return np.cumsum(change[:-1]) > 0

    def regions(self, repeated: np.ndarray):
        """(lo, hi, anchor, again): window starts lo..hi of each region in play; again: its anchor stands in it more than once."""
        starts = np.flatnonzero(self.may_repeat(repeated))
        if not len(starts):
            none = np.empty(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(bool)
        grams = self.hash(np.arange(len(self.bytes) - GRAM + 1), np.arange(GRAM, len(self.bytes) + 1))
        least, width, span = grams, 1, LENGTH - GRAM + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = least[starts]
        doc = np.searchsorted(self.off, starts, "right")
        new = np.r_[True, (np.diff(starts) > 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
        head = np.flatnonzero(new)
        lo, hi, anchor = starts[head], starts[np.r_[head[1:], len(starts)] - 1], anchor[head]
        size = hi - lo + span
        at = np.repeat(lo, size) + _spread(size)
        same = np.add.reduceat((grams[at] == np.repeat(anchor, size)).astype(np.int64), np.cumsum(size) - size)
        return lo, hi, anchor, same > 1


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, from 1, of the suffixes that start at each symbol and reach to its end, by their first `depth` symbols at least.

    Equal suffixes have equal ranks; an end comes before every symbol. Prefix doubling: ranks for twice the
    length are ranks of pairs.
    """
    if not len(symbols):
        return np.empty(0, np.int64)
    here, width, key = np.arange(len(symbols)), 1, symbols
    if symbols.dtype == np.uint8:  # seven bytes and ends fit in one number
        width, key = 7, np.zeros(len(symbols), np.int64)
        for k in range(width):
            then = here + k
            key = key << 9 | np.where(then < ends, symbols[np.minimum(then, len(symbols) - 1)].astype(np.int64) + 1, 0)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    while width < depth:
        then = here + width
        pair = np.where(then < ends, rank[np.minimum(then, len(symbols) - 1)], 0)
        found, new = np.unique(rank * (rank.max() + 1) + pair, return_inverse=True)
        rank, width = new.astype(np.int64) + 1, 2 * width
        if len(found) == len(symbols):
            break
    return rank


def stands_earlier(texts: list[bytes]) -> list[np.ndarray]:
    """For each window start of each text, whether an equal window starts earlier: in a text before it or before in its own.

    The texts are parsed; dictionary and parse are put in order apart and combined (see above).
    """
    block = Block(b"".join(texts), np.array([len(t) for t in texts], np.int64))
    off, n = block.off, len(block.bytes)
    # Phrases: from the start of a text or a trigger through the next trigger, or to the end of the text.
    begin = np.unique(np.r_[off[:-1], block.trig])
    begin = begin[begin < n]
    text = np.searchsorted(off, begin, "right") - 1
    last = np.r_[text[1:] != text[:-1], True]
    stop = np.where(last, off[text + 1], np.minimum(np.r_[begin[1:], n] + TRIGGER, off[text + 1]))
    data = block.bytes.tobytes()
    phrases = [data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    dictionary = sorted(set(phrases))
    number = {p: k for k, p in enumerate(dictionary)}
    parse = np.fromiter(map(number.__getitem__, phrases), np.int64, len(phrases))
    size = np.fromiter(map(len, dictionary), np.int64, len(dictionary))
    place = np.cumsum(size) - size
    of_dictionary = suffix_ranks(np.frombuffer(b"".join(dictionary), np.uint8), np.repeat(place + size, size), LENGTH)
    ends = np.searchsorted(text, text, "right")
    of_parse = np.r_[suffix_ranks(parse, ends, LENGTH), 0]
    # Corpus order of the windows: the rest of the phrase a window starts in, then the parse that follows.
    counts = np.maximum(np.diff(off) - LENGTH + 1, 0)
    at = np.repeat(off[:-1], counts) + _spread(counts)
    mine = np.searchsorted(begin, at, "right") - 1
    rest = of_dictionary[place[parse[mine]] + at - begin[mine]]
    follows = of_parse[np.where(last[mine], len(parse), mine + 1)]
    order = np.lexsort((at, follows, rest))
    a, b = at[order[:-1]], at[order[1:]]
    same = np.ones(len(a), bool)
    eight = np.lib.stride_tricks.as_strided(block.bytes, (max(n - 7, 0), 8), (1, 1))
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same[same] = (eight[a[same] + k].view(np.uint64) == eight[b[same] + k].view(np.uint64)).ravel()
    earlier = np.zeros(len(at), bool)
    if len(order):
        head = np.flatnonzero(np.r_[True, ~same])
        first = np.minimum.reduceat(order, head)
        earlier[order] = order > np.repeat(first, np.diff(np.r_[head, len(order)]))
    return np.split(earlier, np.cumsum(counts)[:-1])


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by keys, and where in it a new combination begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
    return order, new


def _deal(bucket: np.ndarray) -> list[np.ndarray]:
    """Row numbers by bucket, in order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)


def _spread(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


class Work:
    """A block at work: what it asks in each round, and what it makes of the answers."""

    def __init__(self, row: dict, buckets: int):
        self.block = Block(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=1 << 31) if row["data"] else b"", np.array(row["sizes"], np.int64))
        self.buckets = buckets
        self.answers = [{a["bucket"]: a["bits"] for a in row.get(k) or []} for k in ("phrase_bits", "region_bits")]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def ask_phrases(self):
        h = self.block.phrases()
        bucket = self._bucket(h)
        return [(int(bucket[rows[0]]), h[rows].astype(np.uint32).tobytes()) for rows in _deal(bucket)]

    def _regions(self):
        """The regions, which of them are the first of their bytes here, and what is asked: row numbers by bucket."""
        h = self.block.phrases()
        repeated, bucket = np.zeros(len(h), bool), self._bucket(h)
        for rows in _deal(bucket):
            repeated[rows] = np.unpackbits(np.frombuffer(self.answers[0][int(bucket[rows[0]])], np.uint8), count=len(rows))
        lo, hi, anchor, again = self.block.regions(repeated)
        data, seen, first = self.block.bytes.tobytes(), set(), np.zeros(len(lo), bool)
        held = [data[a:b] for a, b in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)]
        for k, x in enumerate(held):
            if x not in seen:
                seen.add(x)
                first[k] = True
        asked = np.flatnonzero(first)
        return lo, hi, anchor, again, held, first, [asked[rows] for rows in _deal(self._bucket(anchor[asked]))]

    def ask_regions(self):
        """For each bucket: the number of regions, their anchors, sizes, whether an anchor comes again, and their bytes."""
        _, _, anchor, again, held, _, asked = self._regions()
        out = []
        for rows in asked:
            texts = [held[k] for k in rows.tolist()]
            size = np.fromiter(map(len, texts), np.uint32, len(texts))
            parts = (np.array([len(rows)], np.uint32), anchor[rows], size, again[rows].astype(np.uint8))
            out.append((int(self._bucket(anchor[rows[:1]])[0]), b"".join([*(p.tobytes() for p in parts), *texts])))
        return out

    def judge(self):
        """(n_bytes, n_removed, n_spans, kept_sha256) for each text."""
        lo, hi, anchor, _, _, first, asked = self._regions()
        x, off = self.block.bytes, self.block.off
        change = np.zeros(len(x) + 1, np.int32)
        np.add.at(change, lo[~first], 1)
        np.add.at(change, hi[~first] + LENGTH, -1)
        for rows in asked:
            count = (hi - lo + 1)[rows]
            bits = np.unpackbits(np.frombuffer(self.answers[1][int(self._bucket(anchor[rows[:1]])[0])], np.uint8), count=int(count.sum())).astype(bool)
            at = (np.repeat(lo[rows], count) + _spread(count))[bits]
            np.add.at(change, at, 1)
            np.add.at(change, at + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        heads = off[:-1][off[:-1] < off[1:]]
        starts[heads] = gone[heads]
        n_gone, n_spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(starts)]
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            cut = int(n_gone[b] - n_gone[a])
            kept = x[a:b][~gone[a:b]] if cut else x[a:b]
            yield b - a, cut, int(n_spans[b] - n_spans[a]), hashlib.sha256(kept.tobytes()).hexdigest()


def _pack(block_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=1)

        def row(ids, texts):
            nonlocal seq
            seq += 1
            sizes = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), sizes, pa.array([press.compress(b"".join(texts))], pa.binary())], ["block_no", "doc_ids", "sizes", "data"])

        ids, texts, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or b""
                if texts and size + len(t) > block_bytes:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(d)
                texts.append(t)
                size += len(t)
        if texts:
            yield row(ids, texts)

    return run


def _asker(step: str, buckets: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                asked = getattr(Work(row, buckets), step)()
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in asked], pa.int32()), pa.array([row["block_no"]] * len(asked), pa.int64()), pa.array([a[1] for a in asked], pa.binary())], ["bucket", "block_no", "keys"])

    return run


def _answer(decide):
    """One bucket: the messages of all blocks in corpus order, decided together, answered block by block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block_no")
        bits = decide([raw.as_buffer().to_pybytes() for raw in t.column("keys")])
        return pa.table({"block_no": t.column("block_no"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def _seen_twice(messages: list[bytes]) -> list[bytes]:
    h = np.frombuffer(b"".join(messages), "<u4")
    order, new = _runs(h)
    out = np.empty(len(h), bool)
    out[order] = ~new | np.r_[~new[1:], False]
    return [np.packbits(p).tobytes() for p in np.split(out, np.cumsum([len(m) // 4 for m in messages])[:-1])]


def _settle(messages: list[bytes]) -> list[bytes]:
    """Which windows of the regions told stand earlier, a bit for each; messages as ask_regions makes them, in corpus order."""
    number: dict[bytes, int] = {}  # distinct regions, by first appearance
    anchors: dict[int, list[int]] = {}
    unsure: set[int] = set()
    told: list[list[tuple[int, bool]]] = []
    for m in messages:
        n = int(np.frombuffer(m, np.uint32, 1)[0])
        anchor = np.frombuffer(m, np.uint64, n, 4).tolist()
        size = np.frombuffer(m, np.uint32, n, 4 + 8 * n)
        again = np.frombuffer(m, np.uint8, n, 4 + 12 * n).tolist()
        at, mine = 4 + 13 * n, []
        for a, z, r in zip(anchor, size.tolist(), again, strict=True):
            x = m[at : at + z]
            at += z
            if known := x in number:
                k = number[x]
            else:
                k = number[x] = len(number)
                anchors.setdefault(a, []).append(k)
                if r:
                    unsure.add(a)
            mine.append((k, known))
        told.append(mine)
    texts = list(number)
    earlier: dict[int, np.ndarray] = {}
    batch, size = [], 0
    open_ones = [ks for a, ks in anchors.items() if len(ks) > 1 or a in unsure]
    for k, ks in enumerate(open_ones, 1):
        batch += ks
        size += sum(len(texts[x]) for x in ks)
        if size >= ORDER_BYTES or k == len(open_ones):
            batch.sort()
            earlier.update(zip(batch, stands_earlier([texts[x] for x in batch]), strict=True))
            batch, size = [], 0
    out = []
    for mine in told:
        parts = [np.ones(len(texts[k]) - LENGTH + 1, bool) if known else earlier.get(k, np.zeros(len(texts[k]) - LENGTH + 1, bool)) for k, known in mine]
        out.append(np.packbits(np.concatenate(parts)).tobytes())
    return out


ROUNDS = (("ask_phrases", "phrase_bits", _seen_twice), ("ask_regions", "region_bits", _settle))
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """REPORT's columns for every row of docs(doc_id, text).

    Null text counts as empty; nothing is removed from texts below 100 bytes. A null doc_id comes before
    all others; rows with one doc_id are ordered by a hash of their text, then by text, and of repeated
    rows the first stays whole. An empty table gives an empty result. Other columns are not looked at. A
    task holds one block, or one document whole if that is longer, with some 80 bytes of memory for each
    of its bytes; or the distinct regions of one bucket, of which it puts ORDER_BYTES, or one anchor's if
    that is more, in order at once.
    """
    spark = docs.sparkSession
    name, work = f"blocks_{uuid.uuid4().hex}", scratch(spark, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    parts = max(min(total // PART_BYTES[0], FEW_PARTS), total // PART_BYTES[1], int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(parts, MOST_PARTS)
    done = scratch(spark, "repeats-report")
    try:
        small_batches(spark, 500)
        rows = rows.withColumn("h", F.xxhash64("text"))
        packed = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(_pack(block_bytes), "block_no long, doc_ids array<long>, sizes array<long>, data binary")
        packed.write.bucketBy(parts, "block_no").option("compression", "uncompressed").option("path", f"{work}/blocks").saveAsTable(name)
        del packed
        release(spark)
        small_batches(spark, 1)  # a row is a block
        state = spark.table(name)
        for step, column, decide in ROUNDS:
            asked = state.mapInArrow(_asker(step, buckets), "bucket int, block_no long, keys binary").repartition(parts, "bucket")
            asked.groupBy("bucket").applyInArrow(_answer(decide), "block_no long, bucket int, bits binary").write.parquet(f"{work}/{column}")
            del asked
            release(spark)
            answers = spark.read.parquet(f"{work}/{column}").groupBy("block_no").agg(F.collect_list(F.struct("bucket", "bits")).alias(column))
            state = state.join(answers.hint("shuffle_hash"), "block_no", "left")

        def final(batches):
            for b in batches:
                for row in b.to_pylist():
                    cols = zip(*Work(row, buckets).judge(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], [c.split()[0] for c in REPORT.split(", ")])

        state.mapInArrow(final, REPORT).write.parquet(done)
    finally:
        small_batches(spark)
        spark.sql(f"drop table if exists {name}")
        remove(spark, work)
        release(spark)
    return spark.read.schema(REPORT).parquet(done)
