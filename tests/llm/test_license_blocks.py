"""Notices inside long lines and long paragraphs."""

from mapfold.llm import licenses


def test_notice_in_a_long_block(spark):
    other = [f"word{k}" for k in range(400)]
    line = " ".join([*other[:200], "Released under the MIT License", *other[200:]])
    wrapped = "\n".join([*other[:100], "Released under the", "MIT License", *other[100:]])
    rows = spark.createDataFrame([(1, line), (2, wrapped), (3, " ".join(other))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(rows).collect()}
    assert got == {1: ("mit,mit-notice", 1.0), 2: ("mit,mit-notice", 1.0), 3: ("", 0.0)}


def test_labels_that_only_the_join_finds(spark):
    """Paragraphs without an agreed phrase, one word short, in a null-id row and in repeated rows."""
    grant = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files (the copies)"
    short = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express"
    rows = spark.createDataFrame([(1, grant), (1, grant), (None, short), (3, "free of charge to any person"), (4, "x " * 5000 + "\n\n" + grant), (5, ""), (6, None)], "doc_id long, text string")
    got = [(r.doc_id, r.base_labels, r.labels) for r in licenses.license_scan(rows).collect()]
    want = [(1, "", "mit-grant")] * 2 + [(None, "", "apache-header"), (3, "", ""), (4, "", "mit-grant"), (5, "", ""), (6, "", "")]
    assert sorted(got, key=str) == sorted(want, key=str)
