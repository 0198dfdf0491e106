"""Templates over several lines, scattered words, and the two ways of joining."""

import textwrap

import pytest

from eventlantern.llm import licenses

LONG = {label: text for label, text in licenses.TEMPLATES if len(text.split()) > 20}


def labels(spark, texts, **more):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, label string, token int")
    return {r.doc_id: (r.labels, r.score) for r in licenses.license_labels(df, **more).collect()}


@pytest.mark.parametrize("most", [0, licenses.BROADCAST_ROWS])
def test_whole_notices_wrapped_as_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", most)
    texts = ["\n".join(" * " + x for x in textwrap.wrap("Some words before. " + t.title() + ". And some after.", 60)) for t in LONG.values()]
    got = labels(spark, texts)
    for k, label in enumerate(LONG):
        assert label in got[k][0].split(",") and got[k][1] == 1.0, (label, got[k])


def test_scattered_words_are_no_notice(spark):
    filler = " ".join(f"filler{k}" for k in range(60))
    scattered = f" {filler} ".join("permission is hereby granted free of charge to any person obtaining a copy of this software".split())
    got = labels(spark, [f" {filler} ".join("all rights reserved".split()), f" {filler} ".join("released under the mit license".split()), scattered, "x all y rights z reserved"])
    assert [got[k] for k in range(4)] == [("", 0.0), ("", 0.0), ("", 0.0), ("reserved", 1.0)]


def test_a_changed_notice_scores_its_share(spark):
    words = LONG["isc"].split()
    own = set(words)
    cut = [w for w in words if w not in ("fee", "purpose")]
    got = labels(spark, [" ".join(cut), " ".join(cut[:20])])
    assert got[0] == ("isc", (len(own) - 2) / len(own)) and got[1] == ("", 0.0)


def test_long_texts_and_empty_cases(spark):
    text = "some other words here " * 60_000 + "Released under the\nMIT License. " + "and more of them " * 1000
    assert labels(spark, [text, None, "", "\n \n"]) == {0: ("mit", 1.0), 1: ("", 0.0), 2: ("", 0.0), 3: ("", 0.0)}
