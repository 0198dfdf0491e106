"""One incident of many is found by its own folder; a new table is put in place by the tasks."""

import pytest
from pyspark.sql import functions as F

from eventlantern.sources.records import scan, write_records


def test_a_scope_lists_its_own_folder(spark, records, tmp_path):
    path, keys = f"{tmp_path}/r", ["7", "a b", "x=1/2", "50%", "[q]*?{z}"]
    one = records.where("offense_id = '101'")
    rows = one.crossJoin(spark.createDataFrame([(k,) for k in keys], "k string")).withColumn("offense_id", F.col("k")).drop("k")
    write_records(rows, path)
    for k in keys:
        got = scan(spark, path, k)
        assert len({f.rsplit("/", 2)[-2] for f in got.inputFiles()}) == 1 and {f.rsplit("/", 2)[-2] for f in got._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().inputFiles()} == {got.inputFiles()[0].rsplit("/", 2)[-2]}
        assert got.count() == one.count() and {r["offense_id"] for r in got.select("offense_id").collect()} == {k}
    write_records(rows.where("offense_id = '7'").limit(2), path)
    assert scan(spark, path, "7").count() == 2 and scan(spark, path).count() == 2 + 4 * one.count()
    with pytest.raises(FileNotFoundError):
        scan(spark, path, "8")
