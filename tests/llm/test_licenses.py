"""The licence model counts all paragraphs, not those of a sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckwright.llm import licenses


def test_every_paragraph_counts_in_the_model(spark):
    texts = [(i, f"plain line {i}\n\n  \nthe license that {i} needs\nReleased under the MIT License." if i % 2 else f"plain {i}") for i in range(1_500)] + [(None, "plain"), (7, None), (8, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    seen = licenses.scanned(docs)
    assert seen.agg(F.sum("n")).first()[0] == 750 * 3 + 750 + 1
    assert seen.where(F.size("pairs") == 0).count() <= 2
    got = {r.doc_id: (r.n_paragraphs, r.families) for r in licenses.scan(docs, licenses.fit(docs, seen), seen).collect()}
    assert got == {i: (1, "mit") if i is not None and i % 2 else (0, "") for i, _ in texts}


def test_threshold_is_exact_over_counts(spark):
    scores = spark.createDataFrame([(0.1, 9_980.0), (0.6, 11.0), (0.7, 5.0), (0.9, 4.0)], "score double, n double")
    assert licenses.exceeded(scores, 0.001) == 0.6
    assert licenses.exceeded(scores, 0.0005) == 0.7
    assert licenses.exceeded(scores.limit(0), 0.001) == 0.0
