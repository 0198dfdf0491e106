from collections import Counter

import brute
import pytest
from oracle import compare

import corpus_pipeline
from eventlantern.llm import langid, queries
from eventlantern.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    ours, theirs, _ = compare(spark, tiny, queries.QUERIES[name], queries.ORACLES[name])
    assert not ours and not theirs


def test_pipeline_stage_by_stage(spark, tiny, tmp_path):
    """Every stage against its plain version, each on what the stage before it kept."""
    docs = table(spark, tiny, "documents")
    names, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if k else {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, tiny)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        assert k == 4 or docs.columns == names
    (first, kept), (two, unique), (three, clean), (four, safe), (five, pieces) = seen.values()
    assert {r.doc_id for r in kept.collect()} == {d for d, t in first.items() if langid.words_of(t or "")}
    assert {r.doc_id for r in unique.collect()} == {c for _, _, c in brute.classes(list(two.items()))}
    items = [(r.item_id, r.text) for r in table(spark, tiny, "benchmark").collect()]
    assert {r.doc_id for r in clean.collect()} == set(three) - {d for d, _ in brute.contained(list(three.items()), items)}
    redacted = {r.doc_id: r for r in safe.collect()}
    assert set(redacted) == set(four)
    for d, t in four.items():
        if brute.secrets(t)[4]:
            assert "[SECRET]" in redacted[d].text and not brute.secrets(redacted[d].text)[4] and redacted[d].n_chars == len(redacted[d].text)
        else:
            assert redacted[d].text == t
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(five)
    want = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces.collect())
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, tiny).collect()) == want
