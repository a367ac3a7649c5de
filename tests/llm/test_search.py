import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kappaloom.llm import topk

ROWS = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k=10):
    whole = []
    for vec_id, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for q in {(i, tuple(v)) for i, v in whole if i is not None and i % 5 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i is None, i or 0) for i, v in whole if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 13])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(90)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(None, rows[7][1]), (77, rows[7][1]), (77, rows[7][1])]
    rows += [(301, None), (302, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (305, [float("nan")] + [0.0] * 5), (306, [float("inf")] + [0.0] * 5), (310, [0.5, 0.5]), (311, [0.1, -0.1]), (315, []), (320, [0.0] * 6)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], ROWS)
    found = topk.top_k(frame, F.expr("vec_id % 5 = 0"), block=block, query_block=7).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_large_values_and_no_rows(spark):
    rows = [(i, [3.0e4 * i, -2.0e4, 1.5]) for i in range(30)]
    found = topk.top_k(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS), F.expr("vec_id % 5 = 0")).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    assert topk.top_k(spark.createDataFrame([], ROWS), F.expr("vec_id % 5 = 0")).count() == 0


def test_only_candidates_left_are_read_and_scored(monkeypatch):
    scored, whole = [], topk.Lists._scores
    monkeypatch.setattr(topk.Lists, "_scores", lambda self, vectors, rows, query: scored.append(len(rows)) or whole(self, vectors, rows, query))
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 300, (2000, 8))
    vectors[:40] *= 20  # a few long vectors, of which the lists' tops consist
    lists = topk.Lists(vectors)
    queries = vectors[100:105]
    left = lists.top(queries, 3, np.zeros((2000, 5), bool))
    assert scored == [len(rows) for rows, _ in left] and max(scored) <= 40
    # the lists are not read to the end: a full scan reads every entry for every query
    assert lists.entries <= 0.3 * vectors.size * len(queries)
    for (rows, scores), q in zip(left, queries, strict=True):
        assert sorted(scores)[-3:] == sorted(vectors @ q)[-3:]
        assert (scores == vectors[rows] @ q).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.sampled_from([3, 1 << 20, 1 << 25, 1 << 28]), st.integers(1, 4), st.integers(0, 99))
def test_scores_are_whole_numbers_at_any_size(n, dim, size, k, seed):
    rng = np.random.default_rng(seed)
    vectors, queries = rng.integers(-size, size, (n, dim)), rng.integers(-size, size, (3, dim))
    exact = vectors.astype(object) @ queries.T.astype(object)
    for i, (rows, scores) in enumerate(topk.Lists(vectors).top(queries, k, np.zeros((n, 3), bool))):
        assert [int(x) for x in scores] == [exact[r, i] for r in rows]
        assert sorted(map(int, scores))[-k:] == sorted(exact[:, i])[-k:]
