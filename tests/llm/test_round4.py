"""Hard negatives: scores stay in the task that makes them."""

import random

from quirelake.llm import hard_negatives

from .test_round3 import plain_negatives


def test_scores_of_hard_negatives_are_not_shuffled(spark, monkeypatch):
    """The same rows where long vectors make blocks smaller and an anchor's scores are made a few at a time."""
    for name, value in {"ANCHORS": 9, "CELLS": 700, "SLICE": 2, "FAN": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(8)
    rows = [(k, k % 3, [r.randint(-9, 30) for _ in range(r.choice([0, 3, 40, 100]))], k % 5 == 0) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>, is_anchor boolean")
    out = hard_negatives.mine(df)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain_negatives(rows)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "scores" not in plan
