"""The pipeline's stages on an empty table, on nulls, and on columns with the operators' own names."""

from pyspark.sql import functions as F

import corpus_pipeline
from eventlantern.llm.common import table

CLASHES = ("blob", "spans", "_held", "_kept", "_KEPT_", "_text", "node", "root", "group", "_gone", "_blob", "queue", "h", "fp")


def through(spark, docs, sf_dir, path):
    """Rows after each stage; every stage but the last returns the columns it got."""
    names, sizes = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        assert k == 4 or docs.columns == names
        sizes.append(docs.count())
    return sizes, docs


def test_clashing_columns_and_nulls(spark, tiny, tmp_path):
    docs = table(spark, tiny, "documents").limit(60)
    odd = docs.limit(2).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(docs.limit(2).withColumn("text", F.lit("")))
    docs = docs.unionByName(odd)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(1))
    docs.write.parquet(f"{tmp_path}/docs")
    sizes, pieces = through(spark, spark.read.parquet(f"{tmp_path}/docs"), tiny, f"{tmp_path}/a")
    assert sizes[0] >= 55 and sizes[2] <= sizes[1] <= sizes[0] and sizes[3] == sizes[2] and pieces.where("doc_id is null").count() >= 2


def test_empty_table(spark, tiny, tmp_path):
    assert through(spark, table(spark, tiny, "documents").limit(0), tiny, tmp_path)[0] == [0] * 5
