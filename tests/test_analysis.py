"""Texts analysed in batches give what the column functions give, with one pass of patterns over distinct pieces."""

import random

from pyspark.sql import functions as F

from eventlantern.functions.analysis import analysed_text
from eventlantern.functions.identifiers import identifiers, values_of
from eventlantern.functions.text import word_list
from eventlantern.operators.documents import text_documents

PIECES = (
    "10.0.0.1", "1.2", "1.2.3.4.5", "v1.2.3", "tool-1.exe", "x-tool.exe.local", "a.exe.", "WS-12.corp.example.org", "ws-12", "ws-12_x", "foo-1.bar-2", "end.", "the", "The", "of", "e.g.", "-a1-b2-", "2026-01-02T03:04", "host.name_part", "ab.cd-ef1-2_x",
    "d41d8cd98f00b204e9800998ecf8427e", "D41D8CD98F00B204E9800998ECF8427E.", "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-426614174000.", "HKLM\\Soft ware\\Run.", "hkcu/a/b", "\\MACHINE\\\\X.Y", "C:\\Temp\\drop.dll", "http://a.b-1.example:80/x.php?y=1",
    "naïve.txt", "größe-1a", "файл-7x.exe", "İstanbul.exe", "\u212aelvin-1", "中文.doc1", "a\u00a0b-1c", "x\u0085y.zz1", '"quoted-1a.",', "(par.en1)", "registry.exe,registry.dll", "", "-", ".", "...", "a..b..c1", "_a-b1", "$x~1.exe",
)
GLUE = (" ", "  ", "\n", "\t", "", ",", "/", "\\", "_", ".", "-", "\u2003")


def texts():
    r = random.Random(7)
    yield from (None, "", *PIECES)
    for _ in range(1500):
        yield "".join(r.choice(PIECES) + r.choice(GLUE) for _ in range(r.randint(1, 9)))
    yield "HKLM\\a.b1 x a.b1 hklm\\A hklm/a.b1"
    yield "deadbeefdeadbeefdeadbeefdeadbeef. x DEADBEEFDEADBEEFDEADBEEFDEADBEEF-a1.b2"


def test_batches_give_what_columns_give(spark):
    given = spark.createDataFrame(list(enumerate(texts())), "n long, t string").repartition(3)
    rows = given.withColumn("i", identifiers(F.col("t"))).select("n", "t", "i", F.concat(word_list(F.col("t")), values_of(F.col("i"))).alias("w"), analysed_text(F.col("t")).alias("a")).collect()
    for r in rows:
        assert (r["a"]["ids"], r["a"]["tokens"]) == (r["i"], r["w"]), r["t"]


def test_documents_are_analysed_without_patterns_in_the_plan(spark, tiny):
    plan = text_documents(spark.read.parquet(f"{tiny}/documents.parquet"), "doc_id", F.col("text"), "source")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_value_is_read_once_for_all_records_that_hold_it(spark):
    """Fields of records give what their values give as one text, where paths run on into later values and a host of one is another's file."""
    import pyarrow as pa

    from eventlantern.functions import analysis

    r, pool = random.Random(11), [t for t in texts() if t][:400]
    rows = [[(r.choice(("a.b", "c_d")), r.choice(pool)) for _ in range(r.randint(0, 6))] for _ in range(800)]
    given = spark.createDataFrame(list(enumerate(rows)), "n long, told array<struct<name:string,value:string>>")
    got = {x["n"]: (x["a"]["ids"], x["a"]["tokens"]) for x in given.select("n", analysis.analysed_fields(F.col("told"), lambda n: n).alias("a")).collect()}
    whole = given.withColumn("t", F.array_join("told.value", " ")).select("n", identifiers(F.col("t")).alias("i")).collect()
    for x in whole:
        words = [w for name, value in rows[x["n"]] for w in analysis.words(name) + analysis.words(value.lower())]
        assert got[x["n"]] == (x["i"], words + [v for c in x["i"] for v in c]), rows[x["n"]]
    seen, read = [], analysis.words
    analysis._values.clear()
    analysis.words = lambda low: seen.append(low) or read(low)
    try:
        made = []
        whole_run = analysis.F.arrow_udf
        analysis.F.arrow_udf = lambda f, _: made.append(f) or (lambda c: c)
        analysis.analysed_fields(F.lit(None), lambda n: n)
        for _ in range(3):
            made[0](pa.array([[{"name": "n", "value": "ws-12 v"}]] * 5))
    finally:
        analysis.words, analysis.F.arrow_udf = read, whole_run
    assert seen.count("ws-12 v") == 1
