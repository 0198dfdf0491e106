import pytest
from oracle import compare

import __spark_entry__ as entry
from eventlantern.cli import main
from eventlantern.plans.oracles import ORACLES
from eventlantern.plans.queries import QUERIES


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["doc_id", "score", "matched_terms", "matched_identifiers"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    ours, theirs, _ = compare(spark, tiny, QUERIES[name], ORACLES[name])
    assert not ours and not theirs


def test_cli(spark, incidents, capsys):
    raw, rec = incidents
    for args, want in [
        (["resolve", "--question", "source ip"], '"best_field": "qradar.sourceip"'),
        (["answer", "--records", rec, "--offense-id", "102", "--question", "what is the source ip"], '"event_count": 2'),
        (["search", "--records", rec, "--query", "cmd.exe", "--limit", "1"], '"offense_id": "103"'),
        (["route", "--records", rec, "--offense-id", "101", "--query", "sampleplatform.exe"], '"method": "bm25"'),
        (["inventory", "--raw", raw, "--records", rec], '"number_of_events": 11'),
    ]:
        assert main(args, spark) == 0
        assert want in capsys.readouterr().out
