import hashlib
import math
import random
import statistics
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kappaloom.functions import numeric
from kappaloom.functions.labels import LABELS
from kappaloom.operators import agreement, audit, resample
from kappaloom.operators import agreement as ag

SCHEMA = "id string, gold string, pred string, gold_start int, gold_end int, pred_start int, pred_end int"


def rows_of(counts, spans=None):
    """Rows that have a confusion matrix; spans by (gold, pred) or one token each."""
    out = []
    for (g, p), n in counts.items():
        for _ in range(n):
            a, b = (spans or {}).get((g, p), ((3, 7), (3, 7)))
            out.append((f"r{len(out)}", g, p, *(a if g != "neutral" else (None, None)), *(b if p != "neutral" else (None, None))))
    return out


E, C, N = LABELS
#: A published matrix of two annotators over 180 items: accuracy 0.95, kappa 0.92464.
PUBLISHED = {(E, E): 64, (E, C): 2, (E, N): 4, (C, C): 59, (N, E): 3, (N, N): 48}


def test_published_agreement(spark):
    # 171 of 180 right; the margins give the published kappa's formula
    frame = spark.createDataFrame(rows_of(PUBLISHED), SCHEMA)
    out = ag.summary(frame).first()
    n = sum(PUBLISHED.values())
    po = sum(v for (g, p), v in PUBLISHED.items() if g == p) / n
    gold, pred = Counter(), Counter()
    for (g, p), v in PUBLISHED.items():
        gold[g] += v
        pred[p] += v
    pe = sum(gold[x] * pred[x] for x in LABELS) / n**2
    assert out.n == 180 and out.accuracy == pytest.approx(0.95) and out.kappa == pytest.approx((po - pe) / (1 - pe))
    assert out.s_span_both == 125 and out.s_span_same == 123
    assert out.joint_iou <= out.accuracy and out.neutral_absence == pytest.approx(48 / 51)


def test_kappa_is_symmetric_and_has_policies_at_chance_one(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.choice(LABELS), rng.choice(LABELS), None, None, None, None) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    turned = frame.withColumnsRenamed({"gold": "x"}).withColumnsRenamed({"pred": "gold"}).withColumnsRenamed({"x": "pred"})
    assert frame.agg(ag.kappa()).first()[0] == pytest.approx(turned.agg(ag.kappa()).first()[0])
    one = spark.createDataFrame(rows_of({(E, E): 5}), SCHEMA)
    got = {p: one.agg(ag.kappa(ag.Policy(chance_one=p))).first()[0] for p in ("one", "zero", "nan", "exact")}
    assert got["one"] == 1 and got["zero"] == 0 and math.isnan(got["nan"]) and got["exact"] == 1


def test_empty_and_all_neutral(spark):
    empty = ag.summary(spark.createDataFrame([], SCHEMA)).first()
    assert empty.n == 0 and empty.accuracy is None and empty.token_f1_both is None
    neutral = ag.summary(spark.createDataFrame(rows_of({(N, N): 4}), SCHEMA)).first()
    assert neutral.joint_iou == 1 and neutral.joint_exact == 1 and neutral.s_span_both == 0 and neutral.iou_both is None


def test_confusion_and_classes(spark):
    frame = spark.createDataFrame(rows_of(PUBLISHED), SCHEMA)
    matrix = {r.gold: r for r in ag.confusion(frame).collect()}
    assert all(matrix[g][p] == PUBLISHED.get((g, p), 0) for g in LABELS for p in LABELS)
    classes = {r.label: r for r in ag.per_class(frame).collect()}
    assert classes[C].precision == pytest.approx(59 / 61) and classes[C].recall == 1 and classes[N].support == 51
    means = ag.averaged(ag.per_class(frame)).first()
    assert means.macro_f1 == pytest.approx(sum(c.f1 for c in classes.values()) / 3)
    assert means.weighted_recall == pytest.approx(171 / 180)
    none = ag.averaged(ag.per_class(spark.createDataFrame([], SCHEMA))).first()
    assert none.macro_f1 == 0 and none.weighted_f1 == 0


def test_disagreements_and_transitions(spark):
    spans = {(E, E): ((1, 4), (2, 4)), (C, C): ((1, 2), (1, 2))}
    frame = spark.createDataFrame(rows_of({(E, E): 2, (C, C): 3, (E, N): 1, (N, N): 1}, spans), SCHEMA)
    assert ag.disagreements(frame).count() == 3
    both = frame.withColumn("pred2", F.when(F.col("gold") == C, F.lit(E)).otherwise(F.col("gold")))
    found = {(r.transition, r.changed): r.n for r in ag.transitions(both, "pred", "pred2").collect()}
    assert found == {("both_right", False): 3, ("right_then_wrong", True): 3, ("wrong_then_right", True): 1}


def test_flips_count_cases_once(spark):
    rows = [(1, E, E, E), (1, E, E, C), (2, C, E, C), (3, N, N, N), (3, N, N, N), (3, N, N, N)]
    frame = audit.flagged(spark.createDataFrame(rows, "base_id int, gold string, base_pred string, variant_pred string"))
    out = audit.case_rates(frame).first()
    assert out.cases == 3 and out.flip_rate == pytest.approx((0.5 + 1 + 0) / 3) and out.harmful_rate == pytest.approx(0.5 / 3)
    assert out.beneficial_rate == pytest.approx(1 / 3) and out.consistent == pytest.approx(1 / 3)
    assert audit.stability(frame, "base_id").first().any_flip == 2


def test_seed_aggregates(spark):
    frame = spark.createDataFrame([(1, 0.5), (2, 0.7)], "seed int, v double")
    out = audit.over_seeds(frame, "seed", "v").first()
    assert out["mean"] == pytest.approx(0.6) and out["std"] == pytest.approx(0.1 * 2**0.5) and out.vals == [0.5, 0.7]
    single = frame.where("seed = 1")
    assert audit.over_seeds(single, "seed", "v").first()["std"] == 0 and audit.over_seeds(single, "seed", "v", None).first()["std"] is None


def test_published_chi_square_and_permutation(spark):
    rows = [(i, "a" if i % 2 else "b", "x" if i % 4 < 2 else "y") for i in range(40)] + [(100 + i, "a", "x") for i in range(10)]
    frame = spark.createDataFrame(rows, "id int, g string, l string")
    out = resample.chi_square(frame, "g", "l").first()
    cells = Counter((g, x) for _, g, x in rows)
    r, c = Counter(g for _, g, _ in rows), Counter(x for *_, x in rows)
    chi = sum((cells[g, x] - r[g] * c[x] / 50) ** 2 / (r[g] * c[x] / 50) for g in r for x in c)
    assert out.chi2 == pytest.approx(chi) and out.cramers_v == pytest.approx((chi / 50) ** 0.5)
    p = resample.permutation_p(frame, "g", "l", 50, "s").first()
    assert p.p == pytest.approx((p.exceed + 1) / 51) and 0 < p.p <= 1


def uniform(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def at(u, masses):
    """How many of the exact distribution functions are at most u."""
    total, out, upto = sum(masses), 0, 0
    for m in masses:
        upto += m
        out += Fraction(upto, total) <= u
    return min(out, len(masses) - 1)


def binomial(n, part, whole, u):
    return at(u, [math.comb(n, k) * part**k * (whole - part) ** (n - k) for k in range(n + 1)])


def hypergeometric(whole, part, n, u):
    least = max(0, n + part - whole)
    return least + at(u, [math.comb(part, k) * math.comb(whole - part, n - k) for k in range(least, min(n, part) + 1)])


def test_numbers_are_drawn_by_exact_inverses(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(300):
        whole = rng.choice([1, 2, 7, 60, 500])
        rows.append((rng.choice([1, 2, 30, 200]), rng.randint(0, whole), whole, rng.randint(0, whole), rng.choice([2**-40, rng.random(), rng.random(), 1 - 2**-40])))
    frame = spark.createDataFrame(rows, "n long, part long, whole long, m long, u double")
    c = F.col
    for r in frame.select("*", numeric.binomial(c("n"), c("part"), c("whole"), c("u")).alias("b"), numeric.hypergeometric(c("whole"), c("part"), c("m"), c("u")).alias("h")).collect():
        assert r.b == binomial(r.n, r.part, r.whole, r.u), r
        assert r.h == hypergeometric(r.whole, r.part, r.m, r.u), r


def test_numbers_of_many_trials(spark):
    frame = spark.range(1, 400).select((F.col("id") / 400.0).alias("u"))
    n, part, whole = (F.lit(x).cast("long") for x in (10**10, 1, 5))
    found = frame.select("u", numeric.binomial(n, part, whole, F.col("u")).alias("b"), numeric.hypergeometric(n, n - 7, F.lit(3 * 10**9).cast("long"), F.col("u")).alias("h")).collect()
    normal = statistics.NormalDist(2e9, 4e4)
    assert all(abs(r.b - normal.inv_cdf(r.u)) < 3 for r in found)
    # how many of seven things are drawn, of which each is with a chance of 0.3
    seven = Counter(3 * 10**9 - r.h for r in found)
    assert all(abs(seven[k] / 399 - math.comb(7, k) * 0.3**k * 0.7 ** (7 - k)) < 0.01 for k in range(8))


def walk(kinds, reps, seed, key=()):
    """The tree of halves written out: kinds are counts in order."""
    bits = max(0, (len(kinds) - 1).bit_length())

    def down(rep, bit, node, n):
        if not n:
            return {}
        if bit < 0:
            return {node: n}
        inside = [c for i, c in enumerate(kinds) if i >> (bit + 1) == node]
        left = [c for i, c in enumerate(kinds) if i >> bit == 2 * node]
        x = binomial(n, sum(left), sum(inside), uniform(seed, *key, rep, bit, node))
        return down(rep, bit - 1, 2 * node, x) | down(rep, bit - 1, 2 * node + 1, n - x)

    return {rep: down(rep, bits - 1, 0, sum(kinds)) for rep in range(1, reps + 1)}


def test_kinds_are_drawn_by_the_tree(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([E, C, None]), rng.choice([E, C, N]), rng.choice(["s", "t", None])) for i in range(80)]
    frame = spark.createDataFrame(rows, "id int, gold string, pred string, s string")
    for strata in ([], ["s"], ["gold"]):
        found = {tuple(r[x] for x in ("rep", *dict.fromkeys([*strata, "gold", "pred"]))): r.c for r in resample.drawn(frame, ["gold", "pred"], 6, "x", strata).collect()}
        expected = {}
        of = {"s": 3, "gold": 1}
        null_first = lambda t: tuple((x is not None, x) for x in t)
        for stratum in {tuple(r[of[x]] for x in strata) for r in rows}:
            counts = Counter((r[1], r[2]) for r in rows if tuple(r[of[x]] for x in strata) == stratum)
            kinds = sorted(counts, key=null_first)
            for rep, told in walk([counts[k] for k in kinds], 6, "x", [x for x in stratum if x is not None]).items():
                expected |= {(rep, *(stratum if strata == ["s"] else ()), *kinds[i]): n for i, n in told.items()}
        assert found == expected


def test_bootstrap_of_a_mean(spark):
    frame = spark.createDataFrame([(i, "a" if i < 30 else "b", float(i)) for i in range(40)], "id int, s string, v double")
    counts = resample.drawn(frame, ["id"], 5, "x", ["s"]).groupBy("rep", "s").agg(F.sum("c").alias("n")).collect()
    assert {(r.s, r.n) for r in counts} == {("a", 30), ("b", 10)} and len(counts) == 10
    low, high = resample.bootstrap_mean(frame, "v", 200, "x").first()
    assert low < 19.5 < high and resample.bootstrap_mean(frame, "v", 200, "x").first() == (low, high)
    # the mean of 40 draws has a deviation of 11.54 / 40 ** 0.5
    assert abs(low - (19.5 - 1.96 * 1.825)) < 1.2 and abs(high - (19.5 + 1.96 * 1.825)) < 1.2
    assert resample.bootstrap_mean(frame.where("v < 0"), "v", 5, "x").first() == (None, None)
    sequential = resample.sequential_bootstrap(frame, "v", "id", 300, 2026).first()
    rng, means = random.Random(2026), []
    for _ in range(300):
        means.append(sum(float(rng.randrange(40)) for _ in range(40)) / 40)
    means.sort()
    assert sequential.low == pytest.approx(means[7] + (means[8] - means[7]) * 0.475)


def test_shuffled_tables_keep_their_margins(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abcde"), rng.choice([E, C, N])) for _ in range(120)] + [("f", N)]
    counts = Counter(rows)
    cells = spark.createDataFrame([(g, x, n) for (g, x), n in counts.items()], "g string, l string, o long")
    groups, labels = sorted({g for g, _ in rows}), sorted({x for _, x in rows})
    found = {}
    for r in resample.shuffled_tables(cells, "g", "l", 300, "x").collect():
        found.setdefault(r.rep, Counter())[r.g, r.l] = r.o

    def down(rep, bit, node, vector):
        members = [g for i, g in enumerate(groups) if i >> (bit + 1) == node]
        if not members:
            return {}
        if bit < 0:
            return {(groups[node], x): n for x, n in zip(labels, vector, strict=True) if n}
        left, whole, first = sum(n for (g, _), n in counts.items() if g in [m for m in members if groups.index(m) >> bit == 2 * node]), sum(vector), []
        for j, v in enumerate(vector):
            first.append(hypergeometric(whole, v, left, uniform("x", rep, bit, node, j)) if j < len(vector) - 1 else left)
            left, whole = left - first[-1], whole - v
        return down(rep, bit - 1, 2 * node, first) | down(rep, bit - 1, 2 * node + 1, [v - x for v, x in zip(vector, first, strict=True)])

    whole = [sum(n for (_, x), n in counts.items() if x == y) for y in labels]
    assert len(found) == 300 and all(table == down(rep, 2, 0, whole) for rep, table in found.items())
    # the statistic's mean over all shuffles is (groups - 1)(labels - 1) n / (n - 1)
    r, c = Counter(g for g, _ in rows), Counter(x for _, x in rows)
    chi = [121 * (sum(n * n / r[g] / c[x] for (g, x), n in table.items()) - 1) for table in found.values()]
    assert abs(statistics.mean(chi) - 10 * 121 / 120) < 1.0


def test_paired_deltas_share_draws(spark):
    rng = random.Random(5)
    rows = [(i, *(rng.choice([E, C, N]) for _ in range(3)), rng.randrange(2), rng.randrange(2)) for i in range(80)]
    frame = spark.createDataFrame(rows, "id int, gold string, pred string, pred2 string, joint int, joint2 int")
    found = {r.measure: r for r in resample.paired_deltas(frame, 40, "x").collect()}
    reps = {}
    for r in resample.drawn(frame, ["gold", "pred", "pred2", "joint", "joint2"], 40, "x").collect():
        reps.setdefault(r.rep, []).extend([r] * r.c)

    def f1(rows, name):
        out = 0
        for x in (E, C, N):
            both, either = sum(r.gold == x == r[name] for r in rows), sum((r.gold == x) + (r[name] == x) for r in rows)
            out += 2 * both / either if either else 0
        return out / 3

    deltas = {
        "accuracy": [sum((r.gold == r.pred2) - (r.gold == r.pred) for r in x) / 80 for x in reps.values()],
        "macro_f1": [f1(x, "pred2") - f1(x, "pred") for x in reps.values()],
        "joint": [sum(r.joint2 - r.joint for r in x) / 80 for x in reps.values()],
    }
    for name, values in deltas.items():
        values.sort()
        assert found[name].low == pytest.approx(values[0] + (values[1] - values[0]) * 0.975)
        assert found[name].above == pytest.approx(sum(v > 1e-12 for v in values) / 40) and found[name].below == pytest.approx(sum(v < -1e-12 for v in values) / 40)
    same = resample.paired_cluster_deltas(frame.withColumn("pred2", F.col("pred")).withColumn("k", F.col("id") % 9), ["k"], 20, "x").first()
    assert (same.low, same.high, same.above, same.below) == (0, 0, 0, 0)


def test_kappa_may_refuse(spark):
    one = spark.createDataFrame([(E, E)], "gold string, pred string")
    assert one.agg(agreement.kappa(agreement.Policy(chance_one="raise")).alias("k")).first().k == 1.0
    assert one.agg(agreement.kappa(agreement.Policy(chance_one="zero"), F.lit(3)).alias("k")).first().k == 0.0


def test_spans_that_count(spark):
    rows = [("a", E, E, 1, 2, 1, 2), ("b", E, C, 1, 2, 2, 3), ("c", N, E, None, None, 1, 1), ("d", N, N, None, None, 4, 5), ("e", E, N, 1, 1, None, None)]
    frame = spark.createDataFrame(rows, "id string, gold string, pred string, gold_start int, gold_end int, pred_start int, pred_end int")
    assert sorted(r.id for r in agreement.eligible_ids(frame).collect()) == ["a", "b"]
    assert [r.id for r in agreement.eligible_ids(frame, policy=agreement.Policy("same")).collect()] == ["a"]
    assert tuple(agreement.neutral_disagreements(frame).first()) == (1, 1, 1)


def test_windows_with_scored_spans(spark):
    rows = [(1, 0, [0.2, 0.5, 0.3], -3.0, 4, 6), (1, 1, [0.2, 0.5, 0.3], -1.0, 7, 7), (1, 2, [0.2, 0.5, 0.3], -1.0, 9, 9), (2, 0, [0.1, 0.1, 0.8], -0.5, 1, 1)]
    found = audit.over_scored_windows(spark.createDataFrame(rows, "i int, w int, p array<double>, s double, a int, b int"), "i", "w", "p", "s", "a", "b", 3).orderBy("i").collect()
    assert [tuple(r) for r in found] == [(1, 2, 1, 7, 7), (2, 3, None, None, None)]
