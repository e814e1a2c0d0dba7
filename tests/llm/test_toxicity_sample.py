"""Rows the toxicity network learns from, and windows around a passage."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import toxicity
from pointloom.llm.text import held_out


def test_a_huge_labelled_text_leaves_the_others_in(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, **_: (texts, labels))
    order = [r["id"] for r in spark.range(60).where(~held_out("id")).orderBy(F.xxhash64("id")).collect()]
    for huge in (order[0], order[1]):
        rows = [(i, "word " * 4_000_000 if i == huge else f"text {i}", i % 2) for i in range(60)]
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        texts, given = toxicity.train(docs, labels)
        assert sorted(texts) == sorted(t.encode() for i, t, _ in rows if i != huge and i in order)
        assert {(t, y) for t, y in zip(texts, given)} == {(t.encode(), y) for i, t, y in rows if i != huge and i in order}


def test_the_budget_goes_to_whole_rows_in_order():
    assert toxicity.within_budget([70, 1, 50, 1, 1], 3, 100) == [1, 3, 4]
    assert toxicity.within_budget([70, 1, 50, 1, 1], 5, 100) == [0, 1, 3, 4]
    assert toxicity.within_budget([200, 1, 40], 9, 100) == [1, 2]


def test_every_passage_of_half_a_window_is_whole_in_one():
    place, _ = toxicity.windows(np.array([300]))
    for length in (10, 16):
        for at in range(300 - length + 1):
            assert any(set(range(at, at + length)) <= set(w.tolist()) for w in place)
