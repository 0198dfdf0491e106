"""Sharding over fixed virtual slots.

A record's virtual slot is a hash into a fixed number of slots. Bytes and rows are added up by slot, and
a versioned table maps slots to shards: version 0 deals slots out in turn, each later version is the one
before it with some slots moved so that shards hold nearly equal bytes. A run over new data starts from
the last version stored and stores the next one only if a slot has to move. Records never move but with
their slot. Only the slot table, whose size is fixed, is ever looked at as a whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

SLOTS = 8192
SHARDS = 24
OVERHEAD = 8
TOLERANCE = 0.0005  # of the mean shard


def edit_map(sizes: list[int], shard_of: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """A copy of the map after moving or swapping slots until the largest and smallest shard are close.

    Each step takes the fullest and the emptiest shard and makes the one move or swap that leaves them
    most alike. It ends within the tolerance or when no step helps; each step lowers the sum of squares of
    the loads, so it does end. Shards that the old map does not know start empty; slots of shards beyond
    `shards` are dealt out first. The outcome depends on the arguments only.
    """
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    out = [shard if 0 <= shard < shards else slot % shards for slot, shard in enumerate(shard_of)]
    for slot, shard in enumerate(out):
        if sizes[slot]:
            own[shard].append((sizes[slot], slot))
    for x in own:
        x.sort()
    load = [sum(s for s, _ in x) for x in own]
    close = max(1.0, tolerance * sum(load) / shards)

    def nearest(x: list[tuple[int, int]], want: float, below: int):
        """The slot of x whose size is nearest to want, over 0 and under `below`."""
        k = bisect_left(x, (want, -1))
        near = [y for y in x[max(0, k - 1) : k + 1] if 0 < y[0] < below]
        return min(near, key=lambda y: (abs(y[0] - want), y[1]), default=None)

    while True:
        full, least = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[full] - load[least]
        if gap <= close:
            break
        best, move = gap, None
        if one := nearest(own[full], gap / 2, gap):
            best, move = abs(gap - 2 * one[0]), (one, None)
        if best > close:
            for a in own[full]:
                if a[0] * 2 > gap and (b := nearest(own[least], a[0] - gap / 2, a[0])) and abs(gap - 2 * (a[0] - b[0])) < best:
                    best, move = abs(gap - 2 * (a[0] - b[0])), (a, b)
        if move is None:
            break
        for slot, src, dst in ((move[0], full, least), (move[1], least, full)):
            if slot:
                own[src].remove(slot)
                insort(own[dst], slot)
                load[src] -= slot[0]
                load[dst] += slot[0]
                out[slot[1]] = dst
    return out


class SlotMap:
    """Versions of the map under `path`, a folder each: (virtual_slot, shard, bytes, rows), as many rows as slots."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    def versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n.startswith("version-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("version-")) for n in done)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, bytes long, rows long").parquet(f"{self.path}/version-{version}")

    def shards_of(self, version: int) -> list[int]:
        held = {r[0]: r[1] for r in self.read(version).collect()}  # as many rows as slots
        if len(held) != self.slots:
            raise ValueError(f"the map under {self.path} has {len(held)} slots, not {self.slots}")
        return [held[k] for k in range(self.slots)]

    def store(self, version: int, shard_of: list[int], stats: DataFrame) -> None:
        """Version folders are written once; a folder that a lost run left without its mark is replaced."""
        named = F.split(F.lit(",".join(map(str, shard_of))), ",").cast("array<int>")
        rows = stats.select("virtual_slot", F.get(named, F.col("virtual_slot")).alias("shard"), "bytes", "rows")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version-{version}")

    def rebalance(self, stats: DataFrame, shards: int, tolerance: float = TOLERANCE) -> int:
        """The version to use for stats(virtual_slot, bytes, rows): the last one, or the next if slots have to move.

        The last version is used where it lies within the tolerance for these bytes, or no move helps.
        """
        there = self.versions()
        if not there:
            self.store(0, [k % shards for k in range(self.slots)], stats)
            there = [0]
        old = self.shards_of(there[-1])
        held = {r[0]: r[1] for r in stats.select("virtual_slot", "bytes").collect()}  # as many rows as slots
        new = edit_map([held[k] for k in range(self.slots)], old, shards, tolerance)
        if new == old:
            return there[-1]
        self.store(there[-1] + 1, new, stats)
        return there[-1] + 1


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of docs(doc_id, text).

    The law is `bytes`. A null text counts as no bytes; very long ones count whole. The virtual slot is a
    hash of doc_id and text, so that rows that share a doc_id spread; exact repeats of a row share a slot
    and each get a place of their own. `slot` numbers the rows of a shard from 0 without a gap, by virtual
    slot and doc_id. An empty table gives an empty result; columns other than doc_id and text are not
    looked at. The map's versions are kept under `map_path`: a later call with that path starts from the
    last of them and stores the next one if slots have to move. Without a path the map is kept for this
    run only.
    """
    spark = docs.sparkSession
    path = map_path or scratch(spark, "slot-map")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    stats = materialize(every.join(held, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")), "slot-stats")
    slot_map = SlotMap(spark, path, slots)
    version = slot_map.rebalance(stats, shards)
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    now = slot_map.read(version).select("virtual_slot", "shard").join(F.broadcast(stats), "virtual_slot")
    placed = now.select("virtual_slot", "shard", F.lit(version).alias("map_version"), F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("nth", nth).join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
