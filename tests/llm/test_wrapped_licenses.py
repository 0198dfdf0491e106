"""Notices wrapped over lines, against all runs of words."""

import re

import brute

from eventlantern.llm import licenses

MIT = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files, to deal in the Software\n */"
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"
GPL = "This work is licensed under the GNU\nGeneral Public License\nversion 3."
MPL = "This Source Code Form is subject to the terms of the\nMozilla Public\nLicense, v. 2.0."
FAR = BSD.replace("or without\n", "or without\n" + "other words stand here\n" * 5)


def plain(t, threshold):
    """(labels, score) where a block is a line or a run of as many words as the template has."""
    *_, starts, first, last, base, labels, score = brute.licenses(t, licenses.TEMPLATES, threshold)
    every, w = set(filter(None, labels.split(","))), re.findall(licenses.WORD, brute.lower(t))
    for label, text in licenses.TEMPLATES:
        n, own = len(text.split()), set(text.split())
        share = max((len(own & set(w[i : i + n])) / len(own) for i in range(len(w))), default=0)
        if share >= threshold - 1e-12:
            every.add(label)
            score = max(score, share)
    return ",".join(sorted(every)), score


def test_wrapped_notices(spark, tiny):
    texts = [MIT, BSD, GPL, MPL, FAR, "x " * 300 + MIT, MIT.replace("\n", " "), MIT + "\n" + BSD, BSD.replace(" ", "\n"), "", None, "\n\n"]
    tests = [(k, t) for k, t in enumerate(texts)]
    for threshold in (licenses.THRESHOLD, 0.5):
        got = {r.doc_id: (r.labels, r.score) for r in licenses.license_labels(spark.createDataFrame(tests, "doc_id long, text string"), threshold=threshold).collect()}
        assert got == {k: plain(t, threshold) for k, t in tests}
    got = {r.doc_id: r.labels for r in licenses.license_labels(spark.createDataFrame(tests, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(9)] == ["mit", "bsd", "gpl", "mpl", "", "mit", "mit", "bsd,mit", "bsd"]
