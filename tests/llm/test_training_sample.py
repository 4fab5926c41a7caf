"""The bounds of the toxicity sample under skew."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity


def test_copies_of_a_text_do_not_break_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 100)
    for copied in ("same text a", "same text b", "same text c", "same text d", "same text e", "same text f"):
        texts = [copied if i % 3 == 0 else f"text {i}" for i in range(1200)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, toxic int")
        rows = [r.text for r in toxicity.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic").collect()]
        assert len(rows) == 100
        assert 10 <= rows.count(copied) <= 60
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 200)
    rows = [r.text for r in toxicity.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic").collect()]
    assert 180 <= sum(map(len, rows)) <= 200
    assert toxicity.training_rows(docs, labels.limit(0), F.lit(True), "doc_id", "text", "toxic").count() == 0


def test_repeated_rows_cost_no_other_row(spark):
    rows = [(i, f"text {i}") for i in range(199)] + [(999, "the one that is repeated")] * 12_500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(199), 999)], "doc_id long, toxic int")
    found = [r.text for r in toxicity.training_rows(docs, labels, F.lit(True), "doc_id", "text", "toxic").collect()]
    assert sorted(found) == sorted({t for _, t in rows})


def test_repeated_rows_of_a_language_cost_no_other_row(spark):
    rows = [(i, f"text {i}", "de") for i in range(300)] + [(999, "the one that is repeated", "de")] * 12_500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found, sizes = langid.sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert sorted(r.text for r in found.collect()) == sorted({t for _, t, _ in rows}) and sizes == {"de": 12_800}


def test_noisy_or_and_its_gradient_are_those_of_the_plain_formulas():
    """The score of a document against 1 - prod(1 - p), one sentence after the other, and toxic words found in sentences."""
    import math

    texts = [f"the weather is fine today. we walk {i} miles" for i in range(40)] + [f"the weather is fine. you are a vile idiot {i}" for i in range(40)]
    model = toxicity.fit(texts, np.array([0] * 40 + [1] * 40))
    chance = lambda s: 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in set(toxicity.features(s))))))
    for text in (texts[0], texts[45], "you are a vile idiot. you are a vile idiot", ""):
        whole, each = model.document(text)
        plain = [chance(s) for s in toxicity.SENTENCE.split(text)]
        assert all(math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-12) for p, q in zip(each, plain, strict=True))
        assert math.isclose(whole, 1 - math.prod(1 - p for p in plain), rel_tol=1e-9, abs_tol=1e-9)
    assert model.document(texts[45])[0] > 0.5 > model.document(texts[0])[0]
