"""Raw incidents (JSON files) and event records (a Parquet table partitioned by offense_id)."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import FIELD

RAW_NAME = re.compile(r"^offense_([^_]+).*\.json$")
SAFE_NAME = re.compile(r"^[A-Za-z0-9_.-]+\.json$")
RECORDS_NAME = re.compile(r"^event_metadata_records_(.+)\.json$")
RECORDS = f"event_index long, event_id long, load_ord long, fields map<string,{FIELD}>, offense_id string"


def offense_id_of(name: str) -> str | None:
    """The id in a raw file's name."""
    m = RAW_NAME.match(name)
    return m[1] if m else None


def records_id_of(name: str) -> str | None:
    """The id in the name of a JSON records file."""
    m = RECORDS_NAME.fullmatch(name)
    return m[1] if m else None


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def raw_files(spark: SparkSession, raw_dir: str) -> dict[str, list[str]]:
    """offense_id -> names of its raw files, sorted."""
    out: dict[str, list[str]] = {}
    for name in listing(spark, raw_dir):
        if key := offense_id_of(name):
            out.setdefault(key, []).append(name)
    return out


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = file_system(spark, path)
    fs.mkdirs(at.getParent())
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_texts(rows: DataFrame, folder: str, name: str) -> None:
    """rows(offense_id, value) as one file each under folder, called name.format(offense_id). The tasks write, the driver only renames."""
    spark, parts = rows.sparkSession, f"{folder}/_parts"
    rows.write.partitionBy("offense_id").text(parts)
    fs, at = file_system(spark, parts)
    Path = spark._jvm.org.apache.hadoop.fs.Path

    def move(key: str) -> None:
        for s in fs.listStatus(Path(at, key)):
            if s.getPath().getName().startswith("part-"):
                fs.rename(s.getPath(), Path(folder, name.format(unquote(key.removeprefix("offense_id=")))))

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, [n for n in listing(spark, parts) if n.startswith("offense_id=")]))
    fs.delete(at, True)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(offense_id, event_index, event VARIANT), a row for each event of the raw files under path.

    Files are read whole; a byte-order mark is dropped. A file that is not an object with a list of events
    gives no row.
    """
    text = F.regexp_replace("value", "^﻿", "")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json(text).alias("doc"))
    events = files.select(F.regexp_extract("file", RAW_NAME.pattern, 1).alias("offense_id"), F.posexplode(F.try_variant_get("doc", "$.events", "array<variant>")).alias("event_index", "event"))
    return events.select("offense_id", F.col("event_index").cast("long").alias("event_index"), "event")


# The tasks move their own files into place; by default the driver moves every incident's, one after the other.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each offense_id; only the folders of the incidents at hand are replaced. Into a new table nothing is replaced, so its files are put in place by the tasks."""
    rows = records.select(*[c.split()[0] for c in ("event_index", "event_id", "load_ord", "fields", "offense_id")])
    fs, at = file_system(records.sparkSession, path)
    if mode == "overwrite" and not fs.exists(at):
        rows.write.mode("append").options(**BY_TASKS).partitionBy("offense_id").parquet(path)
    else:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("offense_id").parquet(path)


def write_shared(records: DataFrame, path: str) -> None:
    """All records in files that incidents share, sorted by incident, for work over all of them: many small incidents would each cost a file."""
    records.select("event_index", "event_id", "load_ord", "fields", "offense_id").sortWithinPartitions("offense_id").write.parquet(path)


def scan_shared(spark: SparkSession, path: str, offense_id: str | None = None) -> DataFrame:
    """Records of write_shared, of one incident (by the statistics of row groups) or of all."""
    table = spark.read.schema(RECORDS).parquet(path)
    return table.where(F.col("offense_id") == str(offense_id)) if offense_id is not None else table


def available(spark: SparkSession, path: str) -> list[str]:
    """The ids in the records table, sorted."""
    return sorted(unquote(n.removeprefix("offense_id=")) for n in listing(spark, path) if n.startswith("offense_id="))


def scan(spark: SparkSession, path: str, offense_id: str | None = None) -> DataFrame:
    """Records of one incident (by partition pruning) or of all, with load_ord over the whole scope's order.

    Raises FileNotFoundError where the incident, or any incident, is missing.
    """
    if offense_id is not None:  # only its folder is looked at, however many there are
        own = f"{path}/offense_id={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(offense_id))}"
        fs, at = file_system(spark, own)
        if not fs.exists(at):
            raise FileNotFoundError(f"no records of {offense_id}")
        return spark.read.schema(RECORDS).option("basePath", path).parquet(own).where(F.col("offense_id") == str(offense_id))
    if not available(spark, path):
        raise FileNotFoundError(f"no records under {path}")
    return spark.read.schema(RECORDS).parquet(path)


def combine(*sets: DataFrame) -> DataFrame:
    """All record sets one after the other; order is carried by offense_id and load_ord."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


def read_records_json(spark: SparkSession, *paths: str) -> DataFrame:
    """RECORDS's columns of JSON records files: an object with offense_id and a list of events, each identity and fields.

    An event without an offense_id has the file's, or the one in the file's name; one without an index has
    its place. Raises ValueError for a file without a list of events, FileNotFoundError where no file is.
    """
    files = [p for p in paths if file_system(spark, p)[0].exists(file_system(spark, p)[1])]
    if not files:
        raise FileNotFoundError(f"no records file: {', '.join(paths)}")
    doc = F.try_parse_json(F.regexp_replace("value", "^\ufeff", ""))
    rows = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_name").alias("file"), doc.alias("doc"))
    rows = rows.select("file", "doc", F.try_variant_get("doc", "$.events", "array<variant>").alias("events"))
    bad = rows.where("events is null").select("file").first()
    if bad:
        raise ValueError(f"{bad[0]} has no list of events")
    named = F.nullif(F.regexp_extract("file", RECORDS_NAME.pattern, 1), F.lit(""))
    events = rows.select(F.coalesce(F.nullif(F.try_variant_get("doc", "$.offense_id", "string"), F.lit("")), named).alias("own"), F.posexplode("events").alias("pos", "e"))

    def held(v):
        listed = F.schema_of_variant(v).startswith("ARRAY")
        items = F.when(listed, F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.to_json(v)))
        return F.when(v.isNotNull() & ~F.is_variant_null(v), F.struct((~listed).alias("scalar"), items.alias("items"))).cast(FIELD)

    fields = F.transform_values(F.try_variant_get("e", "$.fields", "map<string,variant>"), lambda _, v: held(v))
    told = F.nullif(F.try_variant_get("e", "$.event_identity.offense_id", "string"), F.lit(""))
    place = F.coalesce(F.try_variant_get("e", "$.event_identity.event_index", "bigint"), F.col("pos").cast("long"))
    return events.select(place.alias("event_index"), F.try_variant_get("e", "$.event_identity.event_id", "bigint").alias("event_id"), F.col("pos").cast("long").alias("load_ord"), fields.alias("fields"), F.coalesce(told, "own").alias("offense_id"))


def records_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """offense_id -> path of its JSON records file, by id."""
    found = {records_id_of(n): f"{folder}/{n}" for n in listing(spark, folder) if records_id_of(n)}
    return dict(sorted(found.items()))


def load_records(spark: SparkSession, path: str, offense_id: str | None = None) -> DataFrame:
    """Records of a JSON records file, of a folder of such files, or of a records table; a file given by name comes first.

    Raises FileNotFoundError where the incident, or any incident, is missing.
    """
    if path.endswith(".json"):
        return read_records_json(spark, path)
    files = records_files(spark, path)
    if not files:
        return scan(spark, path, offense_id)
    if offense_id is not None and str(offense_id) not in files:
        raise FileNotFoundError(f"no records of {offense_id}")
    return read_records_json(spark, *(files.values() if offense_id is None else [files[str(offense_id)]]))


def relative(path: str, top: str) -> str:
    """path as seen from the folder top, or as it is where it lies elsewhere."""
    at, base = PurePosixPath(path), PurePosixPath(top)
    return at.relative_to(base).as_posix() if at.is_relative_to(base) else path


def export_json(records: DataFrame, path: str) -> None:
    """The records as JSON lines, a folder for each incident."""
    records.write.mode("overwrite").partitionBy("offense_id").json(path)
