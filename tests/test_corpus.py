"""Operators over vectors against numpy."""

import numpy as np

from tidemark.operators import corpus
from tidemark.operators.corpus import vector_covariance


def test_covariance(spark):
    x = np.random.default_rng(2).standard_normal((60, 4)) @ np.random.default_rng(3).standard_normal((4, 4)) + 100
    rows = [(k % 2, v.tolist()) for k, v in enumerate(x)] + [(0, None), (0, [1.0, None, None, None])]
    got = {(r.label, r.i, r.j): (r.n, r.covariance) for r in vector_covariance(spark.createDataFrame(rows, "label int, v array<double>"), ["label"], "v").collect()}
    for k in (0, 1):
        full = np.cov(x[k::2].T, bias=True)
        first = np.var(np.append(x[k::2, 0], [1.0] * (k == 0)))
        for i in range(4):
            for j in range(i, 4):
                n, c = got.pop((k, i, j))
                alone = i == j == 0
                assert n == 30 + (alone and k == 0)
                assert abs(c - (first if alone else full[i, j])) < 1e-9 * max(1, abs(c))
    assert not got


def test_containment_splits_only_texts_that_may_be_found(spark):
    rows = [(0, "One two three, four FIVE six."), (1, "one two three four five six"), (2, None), (3, "a b"), (4, "x1 y2 z3 à ß ÷ q"), (4, "one two three four nine ten")]
    corpus_rows = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([("p", "ONE two three four five six"), ("q", "x1 y2 z3 à ß"), ("r", None)], "item_id string, text string")
    found = corpus.containment_of(asked, corpus_rows, "item_id", "doc_id", "text", 5, 0.2)
    assert sorted(map(tuple, found.collect())) == [("p", 0, 2, 1.0), ("p", 1, 2, 1.0), ("q", 4, 1, 1.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftSemi"):]
    assert "split(" not in below.split("Generate")[0]
