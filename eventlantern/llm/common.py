"""What the corpus operators share: scratch space, reading, lineage cuts, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Unset, a local master (tests) gets one of its own; a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("eventlantern.scratch", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="eventlantern-")
            spark.conf.set("eventlantern.scratch", at)
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders through Hadoop's file system."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches sized for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores before it until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_EDGES = 200_000


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b: long) as rows (node, root), root the smallest node.

    Alternating large-star and small-star: every round is two aggregations with map-side combine, each
    joined back on its key, so a hub's neighbours never meet in one task. Each round is written to the
    shared folder. Up to BROADCAST_EDGES edges the minima, at most two for each edge, are broadcast, so a
    hub's edges stay where they are; beyond that they are joined by key. Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    path = scratch(spark, name)
    e.write.parquet(path)
    e = spark.read.schema("u long, v long").parquet(path)
    mark, n = None, e.count()
    for _ in range(max_rounds):
        near = F.broadcast if n <= BROADCAST_EDGES else lambda df: df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(near(low2), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        old, path = path, scratch(spark, name)
        small.where("u <> v").distinct().write.parquet(path)
        e = spark.read.schema("u long, v long").parquet(path)
        remove(spark, old)
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark, n = tuple(got), got[0]
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
