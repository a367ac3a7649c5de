import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kappaloom.operators import align, temporal, validate


@pytest.mark.parametrize(("width", "hot", "parts"), [(10, 100_000, 64), (10, 0, 4), (7, 3, 3), (1, 0, 1), (500, 5, 10)])
def test_intervals_meet_once(spark, width, hot, parts):
    rng = random.Random(width)
    rows = lambda n: [(i, rng.choice(["a", "b", None]), x, x + rng.choice([-1, 0, 1, 5, 40])) for i in range(n) for x in [rng.randrange(-60, 60)]]
    left, right = rows(60) + [(900, "a", None, 3), (901, "a", 3, None)], rows(60)
    found = temporal.overlapping(spark.createDataFrame(left, "i long, k string, a long, b long"), spark.createDataFrame(right, "j long, k string, c long, d long"), ["k"], ("a", "b"), ("c", "d"), width, hot, parts)
    assert found.columns == ["i", "k", "a", "b", "j", "c", "d"]
    expected = Counter((i, j) for i, k, a, b in left for j, m, c, d in right if k == m is not None and None not in (a, b) and a <= b and c <= d and a <= d and c <= b)
    assert Counter((r.i, r.j) for r in found.collect()) == expected and max(expected.values()) == 1


@pytest.mark.parametrize("minutes", [1, 30, 100_000])
def test_last_row_before(spark, minutes):
    rng = random.Random(3)
    begin = datetime(2024, 1, 1)
    at = lambda: begin + timedelta(minutes=rng.randrange(200))
    left = [(i, rng.choice("uv"), at()) for i in range(120)] + [(500, "u", None), (501, "w", begin), (502, "u", begin - timedelta(days=3))]
    right = [(i, rng.choice("uv"), at(), f"p{i}") for i in range(40)] + [(70, "u", None, "null")]
    bucket = F.floor(F.unix_micros(F.col("_time")) / (minutes * 60_000_000))
    frames = spark.createDataFrame(left, "i long, k string, t timestamp"), spark.createDataFrame(right, "j long, k string, s timestamp, p string")
    found = temporal.as_of(*frames, ["k"], "t", "s", "j", bucket)
    assert found.columns == ["i", "k", "t", "j", "s", "p"]
    for r in found.collect():
        before = [(s, j, p) for j, k, s, p in right if k == r.k and None not in (s, r.t) and s <= r.t]
        assert (r.s, r.j, r.p) == (max(before) if before else (None, None, None))
    assert found.count() == len(left)


def test_sessions(spark):
    times = [0, 10, 39, 70, 100, 129, 130, 500]
    rows = [("u", datetime(2024, 1, 1) + timedelta(minutes=m), 1.0) for m in times] + [("v", datetime(2024, 1, 1), 2.0)]
    found = temporal.sessions(spark.createDataFrame(rows, "u string, t timestamp, v double"), ["u"], "t", "30 minutes", F.sum("v").alias("v")).orderBy("u", "first").collect()
    assert [(r.u, r.n, r.v) for r in found] == [("u", 3, 3.0), ("u", 4, 4.0), ("u", 1, 1.0), ("v", 1, 2.0)]


def test_partners_differ_in_both_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), "same" if rng.random() < 0.4 else f"t{rng.randrange(40)}") for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, g string, c string")
    of = {i: (g, c) for i, g, c in rows}
    found = {r.id: r.partner for r in align.unlike_partners(frame, "id", "g", "c").collect()}
    assert sorted(found) == sorted(found.values()) == sorted(of)
    assert all(of[i][0] != of[p][0] and of[i][1] != of[p][1] and i != p for i, p in found.items())
    with pytest.raises(align.Unpaired, match="more than half"):
        align.unlike_partners(frame.withColumn("c", F.when(F.col("id") < 80, "one").otherwise(F.col("id").cast("string"))), "id", "g", "c")
    with pytest.raises(align.Unpaired, match="after 0 rounds"):
        align.unlike_partners(frame, "id", "g", "c", rounds=0)
    assert align.unlike_partners(frame.limit(0), "id", "g", "c").count() == 0


def test_faults_of_counterfactuals(spark):
    schema = "id long, label string, premise string, law string, text string"
    official = spark.createDataFrame([(i, "E", f"p{i}", None, f"h{i}") for i in range(8)], schema)
    bases = [(0, "E", "p0", None, "h0"), (1, "C", "p1", None, "h1"), (2, "E", "p!", "L", "h2"), (3, "E", "p3", None, "else"), (9, "E", "p9", None, "h9"), (4, "E", "p4", None, "h4"), (4, "E", "p4", None, "h4")]
    variants = [(b, 10 * b + k, "E" if b != 1 else "C", f"p{b}" if b != 2 else "p!", None if b != 2 else "L", f"v{k}", "KEEP") for b in (0, 1, 2, 3, 4, 9) for k in range(4)]
    variants[0] = (0, 0, "N", "p0", None, "h0", "KEEP")
    variants[1] = (0, 1, "E", "p0", None, " ", "DROP")
    variants[2] = (0, 2, "E", "p0", "L", None, None)
    variants += [(7, 70, "E", "p7", None, "v", "KEEP"), (3, 34, "E", "p3", None, "v4", "KEEP")]
    found = validate.challenge_faults(official, spark.createDataFrame(bases, schema), spark.createDataFrame(variants, "id long, variant long, label string, premise string, law string, text string, decision string"), "id", "variant", ["label", "premise", "law"], "text", decision="decision")
    expected = [(1, None, "label"), (2, None, "premise"), (2, None, "law"), (3, None, "text"), (3, None, "variants"), (4, None, "repeated"), (9, None, "unknown")]
    expected += [(0, 0, "label"), (0, 0, "unchanged"), (0, 1, "empty"), (0, 1, "decision"), (0, 2, "empty"), (0, 2, "law"), (0, 2, "decision"), (7, 70, "unknown")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
