"""Intake as a stream: raw files that appear in a folder become records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract
from ..sources.records import RAW_NAME, write_records


def stream_intake(spark: SparkSession, raw_dir: str, records_path: str, checkpoint: str, mapping: dict | None = None) -> StreamingQuery:
    """Every new raw file replaces its incident's partition; of several in one batch the one changed last does, by name if tied.

    Batches are idempotent, so a replay after a failure does no harm.

    The id is in the file's name, or in a folder offense_id=<id> above it.
    """
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").load(raw_dir)
    files = files.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))
    named, placed = F.regexp_extract("file", RAW_NAME.pattern, 1), F.regexp_extract("path", "/offense_id=([^/]+)/", 1)

    def take(batch: DataFrame, _: int) -> None:
        keyed = batch.select(F.when(named != "", named).otherwise(placed).alias("offense_id"), "path", "changed", "value").where("offense_id <> ''")
        last = keyed.groupBy("offense_id").agg(F.max(F.struct("changed", "path"))["path"].alias("path"))
        doc = F.try_parse_json(F.regexp_replace("value", "^\ufeff", ""))
        events = keyed.join(last, ["offense_id", "path"], "left_semi").select("offense_id", F.posexplode(F.try_variant_get(doc, "$.events", "array<variant>")).alias("event_index", "event"))
        write_records(extract(events.withColumn("event_index", F.col("event_index").cast("long")), mapping), records_path)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
