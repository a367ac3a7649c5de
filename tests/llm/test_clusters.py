import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kappaloom.llm import centroids, codebooks

ROWS = "vec_id long, embedding array<double>, label int, code string, cluster string, x string"


def whole(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(centres, rows, at):
    sums = {}
    for (_, v, *_), (_, c) in zip(rows, at, strict=True):
        n, s = sums.get(c, (0, [0] * len(v)))
        sums[c] = n + 1, [x + y for x, y in zip(s, v, strict=True)]
    return [[x // sums[c][0] for x in sums[c][1]] if c in sums else old for c, old in enumerate(centres)]


def brute_clusters(rows, dim, k, rounds, scale=64):
    rows = [r for r in whole(rows, scale) if len(r[1]) == dim]
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v, _ in sorted(rows, key=hashed)[:k]]
    assign = lambda: [min((apart(v, c), i) for i, c in enumerate(centres)) for _, v, _ in rows]
    for _ in range(rounds):
        centres = moved(centres, rows, assign())
    at = assign()
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sum(x for x, y in at if y == c), sum(x for x, _ in at), prints[c]) for (i, *_), (d, c) in zip(rows, at, strict=True)), key=repr)


def brute_codes(rows, parts, k, rounds, scale=4096):
    out = []
    rows = [r for r in whole(rows, scale) if r[1] and len(r[1]) % parts == 0]
    for dim in {len(r[1]) for r in rows}:
        mine, width = [r for r in rows if len(r[1]) == dim], dim // parts
        first = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:k]
        found, values = [("", 0)] * len(mine), []
        for p in range(parts):
            cut = [(i, v[p * width : (p + 1) * width]) for i, v, _ in mine]
            book = [v[p * width : (p + 1) * width] for _, v, _ in first]
            assign = lambda: [min((apart(v, c), i) for i, c in enumerate(book)) for _, v in cut]  # noqa: B023, E731
            for _ in range(rounds):
                book = moved(book, cut, assign())
            found = [(code + f"{e:02x}", error + d) for (code, error), (d, e) in zip(found, assign(), strict=True)]
            values += [str(x) for c in book for x in c]
        sha = hashlib.sha256(",".join(values).encode()).hexdigest()
        out += [(i, code, error, label, sha) for (i, _, label), (code, error) in zip(mine, found, strict=True)]
    sums = {}
    for *_, error, label, _ in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, code, error, sums[label], sha) for i, code, error, label, sha in out), key=repr)


def cases(dim, seed=1, n=120):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centre)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(3, rows[3][1], 1)] * 3 + [(None, rows[9][1], 2), (None, [0.0] * dim, None)]  # repeated rows, rows without an id
    rows += [(500 + i, [0.5 if j % 2 else -0.5 for j in range(dim)], 4) for i in range(40)]  # ties
    return rows + [(900, None, 1), (901, [0.1] * (dim - 1) + [None], 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] + [0.0] * (dim - 1), 1), (904, [], 1), (905, [0.25] * (dim + 8), None), (906, [0.5] * (dim + 8), 7), (907, [0.1] * (dim + 1), 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ROWS)


@pytest.mark.parametrize(("dim", "k"), [(16, 6), (3, 16), (1, 2), (16, 400)])
def test_clusters_equal_brute_force(spark, dim, k):
    rows = cases(dim)
    found = centroids.clusters(frame(spark, rows).repartition(5), k=k, dim=dim).drop("n_exact").collect()
    assert sorted(map(tuple, found), key=repr) == brute_clusters(rows, dim, k, 3)


def test_codes_equal_brute_force(spark):
    rows = cases(16)
    found = codebooks.codes(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_codes(rows, 8, 16, 6)
    few = rows[:7]
    assert sorted(map(tuple, codebooks.codes(frame(spark, few), parts=4).collect()), key=repr) == brute_codes(few, 4, 16, 6)


def test_no_rows_and_too_large_values(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 64, None)]):
        assert centroids.clusters(frame(spark, rows)).collect() == []
        assert codebooks.codes(frame(spark, rows)).collect() == []
    large = frame(spark, [(1, [1e30] * 64, 1), (2, [0.0] * 64, 1)])
    for op in (centroids.clusters, codebooks.codes):
        with pytest.raises(Exception, match="do not fit in 64 bits"):
            op(large)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 50), st.integers(1, 20), st.integers(1, 9), st.sampled_from([2, 50, 1 << 26]), st.integers(0, 999))
def test_screening_loses_no_centroid(n, k, dim, size, seed):
    rng = np.random.default_rng(seed)
    vectors, centres = rng.integers(-size, size, (n, dim)), rng.integers(-size, size, (k, dim))
    bounds = centroids.least_distances(centroids.segments(vectors), centroids.segments(centres))
    exact = [[apart(v, c) for c in centres.tolist()] for v in vectors.tolist()]
    assert (bounds - centroids.SLACK * (1 + np.sqrt(bounds)) <= np.array(exact, float) * (1 + 1e-12)).all()
    best, distance, measured = centroids.nearest(vectors, centroids.segments(vectors), centres)
    assert list(zip(distance.tolist(), best.tolist(), strict=True)) == [min((d, i) for i, d in enumerate(row)) for row in exact]
    assert (measured >= 1).all() and (measured <= k).all()


def test_screening_measures_few_centroids_of_parted_vectors():
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (16, 64))
    vectors = np.repeat(centres, 50, axis=0) + rng.integers(-3, 4, (800, 64))
    assert centroids.nearest(vectors, centroids.segments(vectors), centres)[2].mean() < 2


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(1, 20), st.integers(1, 4), st.sampled_from([1, 2, 30, 1 << 27]), st.integers(0, 999))
def test_bounds_hold_and_decide_no_tie(n, k, width, size, seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-size, size + 1, (n, width)), codebooks.Book(rng.integers(-size, size + 1, (k, width)))
    code, upper, lower, _ = book.first(x)
    for turn in range(6):
        if turn:
            code, upper, lower, _ = book.next(x, code, upper, lower)
        exact = [[apart(v, c) for c in book.entries.tolist()] for v in x.tolist()]
        assert code.tolist() == [min((d, i) for i, d in enumerate(row))[1] for row in exact]
        for row, c, u, low in zip(exact, code.tolist(), upper.tolist(), lower.tolist(), strict=True):
            assert u * u >= row[c]
            assert all(max(0, low[book.group[e]]) ** 2 <= d for e, d in enumerate(row) if e != c)
        book.counts = np.bincount(code, minlength=k).astype(object)
        book.sums = np.zeros(book.entries.shape, object)
        for v, c in zip(x.tolist(), code.tolist(), strict=True):
            book.sums[c] += np.array(v, object)
        book.move()


def test_settled_parts_are_not_measured():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (16, 8))
    x = np.repeat(centres, 60, axis=0) + rng.integers(-20, 21, (960, 8))
    book = codebooks.Book(centres)
    code, upper, lower, full = book.first(x)
    book.counts = np.bincount(code, minlength=16).astype(object)
    book.sums = np.array([x[code == e].sum(axis=0).tolist() for e in range(16)], object)
    book.move()
    assert full == 16 * 960 and book.next(x, code, upper, lower)[3] < 0.1 * full
