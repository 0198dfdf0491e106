"""The ledger over changes of rules, many hits, hot blobs and clashing columns."""

import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from eventlantern.llm import secrets

OLD = replace(secrets.RULES[0], pattern=r"(?i:password)=([a-z]+)", least=3)
NEW = replace(OLD, pattern=r"(?i:password)=([a-z0-9]+)", version=2)


def spans(df):
    return sorted((r.doc_id, r.spans) for r in df.collect())


def test_what_a_superseded_rule_version_found_is_not_reported(spark, tmp_path):
    first = spark.createDataFrame([(1, "password=abcd1234"), (2, "nothing"), (3, "PASSWORD=xyz")], "doc_id long, text string")
    both = first.unionByName(spark.createDataFrame([(4, "password=later9"), (5, "password=abcd1234")], "doc_id long, text string"))
    path = f"{tmp_path}/ledger"
    old = secrets.Ledger(spark, path, (OLD,))
    assert spans(secrets.secret_digests(first, old)) == [(1, "assign:0:13"), (2, ""), (3, "assign:0:12")]
    new = secrets.Ledger(spark, path, (NEW,))
    assert spans(secrets.secret_digests(both, new)) == [(1, "assign:0:17"), (2, ""), (3, "assign:0:12"), (4, "assign:0:15"), (5, "assign:0:17")]
    read = {r.blob: r.n for r in new.rows().groupBy("blob").agg(F.count("*").alias("n")).collect()}
    assert sorted(read.values()) == [1, 2, 2, 2], "old blobs are read once more by the new version only, copies never twice"
    assert spans(secrets.secret_digests(first, old)) == [(1, "assign:0:13"), (2, ""), (3, "assign:0:12")], "and an old version still tells what it found"


def test_rules_in_another_order_list_ties_their_way(spark, tmp_path):
    text = "token=" + "a0" * 20
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.Ledger(spark, f"{tmp_path}/l").update(df)
    turned = secrets.Ledger(spark, f"{tmp_path}/l", secrets.RULES[::-1])
    assert spans(secrets.secret_digests(df, turned)) == [(1, "assign:0:46,hex:6:46")]
    assert turned.rows().count() == 1


def test_hits_cost_what_they_are(spark):
    """A text with sixteen times the hits takes nowhere near 256 times as long, and every position is right."""
    took = {}
    for n in (2_000, 32_000):
        text = "é token=abcdefgh " * n
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        got = secrets.secret_digests(df).first()
        clean = secrets.redact(df).first().text
        took[n] = time.perf_counter() - began
        assert got.spans == ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer("token=abcdefgh", text))
        assert clean == "é [SECRET] " * n
    assert took[32_000] < 40 * max(took[2_000], 0.5)


@pytest.mark.parametrize("most", [0, secrets.BROADCAST_SPANS])
def test_hot_blobs_and_any_column_names(spark, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_SPANS", most)
    rows = [(k, "token=abcdefgh, " + "f" * 40 if k % 3 else f"clean {k}", "b", 1, [2], "h", 0) for k in range(300)] + [(None, None, None, None, None, None, None), (7, "", "b", 1, [2], "h", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string, spans int, pieces array<int>, _held string, n_chars long")
    got = secrets.redact(df)
    assert got.columns == df.columns
    want = sorted(((d, "[SECRET], [SECRET]" if t and "token" in t else t) for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    assert {r.n_chars for r in got.where("text like '[SECRET]%'").collect()} == {18}
    assert secrets.redact(df.limit(0)).count() == 0
    assert secrets.secret_digests(df).count() == len(rows)
