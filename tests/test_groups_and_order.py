import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kappaloom.operators import align, components, graph, lexical, order, validate
from kappaloom.operators.components import connected
from kappaloom.sources.shared import staged_at


def union(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    path = [(i, i + 1) for i in range(60, 90)]
    star = [(100, i) for i in range(101, 130)]
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + path + star + [(5, 5)]
    roots = union(131, links)
    rng.shuffle(links)
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: roots[i] for i in {x for a, b in links if a != b for x in (a, b)}}


@pytest.mark.parametrize("links, rounds", [([(2, 1), (3, 1), (5, 4)], 0), ([], 0), ([(1, 2), (2, 3)], 1)])
def test_stars_need_no_round(spark, monkeypatch, links, rounds):
    written = []
    monkeypatch.setattr(components, "staged_at", lambda df, label: written.append(label) or staged_at(df, label))
    found = {(r.node, r.component) for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = union(6, links)
    assert found == {(i, roots[i]) for pair in links for i in pair}
    assert len(written) == 1 + rounds


def test_groups_of_shared_keys(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, "c", None), (5, None, None), (6, "d", "y"), (7, "e", "y")]
    frame = spark.createDataFrame(rows, "id long, k string, m string")
    found = {r.id: r.group for r in graph.grouped(frame, "id", {"k": F.col("k"), "m": F.col("m")}).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    members = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "id long, group long")
    keyed = spark.createDataFrame([(1, "a"), (2, "a"), (9, "z")], "id long, key string")
    faults = {r.check: r.faults for r in graph.constraint_faults(members, keyed, "id").collect()}
    assert faults == {"exclusive": 1, "covered": 1, "one_group_a_key": 1}


def test_splits_hold_whole_groups(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for g in range(90):
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            rows.append((i, g, rng.choice(["E", "C", "N"])))
            i += 1
    members = spark.createDataFrame(rows, "id long, group long, label string")
    targets = graph.split_targets(members, "label")
    wanted = {(r.label, r.split): r.target for r in targets.collect()}
    counts = Counter(x for *_, x in rows)
    assert all(sum(wanted[x, s] for s in ("train", "validation", "test")) == n for x, n in counts.items())
    split = {r.group: r.split for r in graph.assign_splits(members, targets, "label", restarts=4, swaps=300).collect()}
    assert set(split) == {g for _, g, _ in rows}
    have = Counter((x, split[g]) for _, g, x in rows)
    assert sum(abs(have[k] - n) for k, n in wanted.items()) <= 12
    again = {r.group: r.split for r in graph.assign_splits(members, targets, "label", restarts=4, swaps=300).collect()}
    assert split == again
    folds = {r.group: r.fold for r in graph.folds(members, 5, "s").collect()}
    sizes = Counter(folds[g] for _, g, _ in rows)
    assert set(folds) == set(split) and max(sizes.values()) - min(sizes.values()) <= 5


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(["A", "B", "C", "A,B", "B,C", "A,B,C"]), st.integers(1, 6), min_size=1), st.integers(0, 7))
def test_flow_is_maximal(counts, target):
    labels = sorted({x for o in counts for x in o.split(",")})
    flow = graph._max_flow(labels, sorted(counts), counts, target)
    by_label, by_set = Counter(), Counter()
    for (x, o), n in flow.items():
        assert n >= 0 and x in o.split(",")
        by_label[x] += n
        by_set[o] += n
    assert all(by_label[x] <= target for x in labels) and all(by_set[o] <= counts[o] for o in counts)
    # by Hall's condition: the least over all subsets of labels
    best = min(target * (len(labels) - len(some)) + sum(n for o, n in counts.items() if set(o.split(",")) & set(some)) for some in [[x for i, x in enumerate(labels) if mask >> i & 1] for mask in range(1 << len(labels))])
    assert sum(flow.values()) == best


def test_selection(spark):
    rows = [(i, f"k{i % 9}", "ABC"[i % 3] if i % 9 != 4 else "A") for i in range(60)]
    chosen = graph.one_row_a_key(spark.createDataFrame(rows, "id long, k string, label string"), "id", "k", "label", 2, "s").collect()
    assert len({r.k for r in chosen}) == len(chosen) == 6 and set(Counter(r.label for r in chosen).values()) == {2}


def test_partners_are_of_other_groups(spark):
    rows = [(i, "abc"[i % 3] if i < 20 else "d") for i in range(36)]
    found = align.shifted_partners(spark.createDataFrame(rows, "id long, g string"), "id", "g").collect()
    assert sorted(r.partner for r in found) == sorted(i for i, _ in rows)
    assert all(r.g != r.partner_group for r in found)


def test_positions_gaps_and_spread(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aabc"), rng.randrange(50)) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, k string, t long").withColumn("b", F.floor(F.col("t") / 7))
    placed = {r.id: r for r in order.positions(frame, "b", ["t", "id"], "k").collect()}
    expected = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}
    assert {i: r.pos for i, r in placed.items()} == expected
    near = {r.id: r.nearest for r in order.nearest(order.positions(frame, "b", ["t", "id"], "k"), "k", "pos").collect()}
    by_key = defaultdict(list)
    for i, k, _ in rows:
        by_key[k].append(expected[i])
    for i, k, _ in rows:
        others = [abs(expected[i] - p) for p in by_key[k] if p != expected[i]]
        assert near[i] == (min(others) if others else None)
    spread = {r.id: r.pos for r in order.spread(frame.drop("b"), "k", "id", 3).collect()}
    assert sorted(spread.values()) == list(range(1, 201))
    for k, members in by_key.items():
        places = sorted(spread[i] for i, x, _ in rows if x == k)
        # never further apart than twice the even distance
        assert max(b - a for a, b in zip(places, places[1:], strict=False)) <= 2 * 200 / len(members) + 4


@pytest.mark.parametrize("most", [4, 30])
def test_lots(spark, most):
    rows = [(i, "k%d" % min(i // most, 20)) for i in range(95 if most == 4 else 60)]
    rows = [(i, k) for i, k in rows if k != "k20"]
    dealt = order.lots(spark.createDataFrame(rows, "id long, k string"), "k", "id", 20, 1).collect()
    sizes = Counter(r.lot for r in dealt)
    # no key twice in a lot, whatever that takes
    assert max(Counter((r.k, r.lot) for r in dealt).values()) == 1 and len(dealt) == len(rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == max(-(-len(rows) // 20), most)
    if most == 30:
        with pytest.raises(Exception, match="more rows than"):
            order.lots(spark.createDataFrame(rows, "id long, k string"), "k", "id", 20, 1, strict=True).collect()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=9), st.sampled_from([None, 1, 3]))
def test_best_span(spark, scores, most):
    starts, ends = ([float(x[i]) for x in scores] for i in (0, 1))
    found = spark.createDataFrame([(starts, ends)], "s array<double>, e array<double>").select(order.best_span(F.col("s"), F.col("e"), most).alias("b")).first().b
    spans = [(starts[i] + ends[j], i, j) for i in range(len(scores)) for j in range(i, len(scores)) if most is None or j - i < most]
    assert found.score == max(s for s, *_ in spans) and (found.score, found.first, found.last) in spans


def test_windows_and_batches(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate([0, 3, 4, 5, 11])]
    frame = spark.createDataFrame(rows, "id long, t string").withColumn("w", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", " ")))
    found = defaultdict(list)
    for r in lexical.token_windows(frame, "id", F.col("w"), 4, 3).collect():
        found[r.id].append((r.window, r.first, r.last, len(r.words)))
    assert sorted(found[4]) == [(0, 1, 4, 4), (1, 4, 7, 4), (2, 7, 10, 4), (3, 10, 11, 2)]
    assert found[2] == [(0, 1, 4, 4)] and sorted(found[3]) == [(0, 1, 4, 4), (1, 4, 5, 2)] and found[0] == [(0, 1, 0, 0)]
    sizes = spark.createDataFrame(list(enumerate([3, 3, 3, 9, 1, 1, 1])), "id long, n long")
    assert [r.batch for r in lexical.window_batches(sizes, "id", "n", 2, 6).orderBy("id").collect()] == [0, 0, 1, 2, 3, 3, 4]


@pytest.mark.parametrize(("seed", "block"), [(1, 5), (2, 7), (3, 1000)])
def test_batches_do_not_depend_on_blocks(spark, seed, block):
    rng = random.Random(seed)
    sizes = [(i, rng.choice([1, 1, 2, 3, 8, 20])) for i in range(rng.randrange(30, 60))]
    expected, batch, items, used = [], 0, 0, 0
    for _, n in sizes:
        if items and (items == 4 or used + n > 10):
            batch, items, used = batch + 1, 0, 0
        items, used = items + 1, used + n
        expected.append(batch)
    found = lexical.window_batches(spark.createDataFrame(rng.sample(sizes, len(sizes)), "id long, n long"), "id", "n", 4, 10, block=block).orderBy("id").collect()
    assert [r.batch for r in found] == expected


def test_faults(spark):
    rows = [("a", "entailment", 1, 2), ("a", "neutral", None, None), ("", "odd", None, None), ("b", "neutral", 1, None), ("c", "contradiction", 3, 2), ("d", "contradiction", None, 2), (None, None, -1, 0)]
    frame = spark.createDataFrame(rows, "id string, label string, s int, e int").withColumn("faults", validate.annotation_faults(F.col("label"), F.col("s"), F.col("e"), F.col("id")))
    found = [sorted(r.faults) for r in validate.with_repeats(frame, "id").orderBy(F.col("id").asc_nulls_last(), "label").collect()]
    assert sorted(map(str, found)) == sorted(map(str, [["repeated"], ["repeated"], ["id", "label"], ["neutral_span"], ["order"], ["missing_span"], ["id", "label", "start"]]))


def test_strict_integers(spark):
    raw = ['{"k": 8}', '{"k": 8.0}', '{"k": "8"}', '{"k": true}', '{"k": 8, "x": 1}', '{"x": 8}', "no", None, '{"k": 0}', '{"k": 91}', '{"k": null}']
    found = spark.createDataFrame(list(enumerate(raw)), "i int, r string").select("i", validate.strict_integer_object(F.col("r"), "k", 90).alias("k")).orderBy("i").collect()
    assert [r.k for r in found] == [8] + [None] * 10


def test_report_and_manifest(spark):
    left, right = (spark.createDataFrame([(x,) for x in ids], "id long") for ids in ([1, 2, 3], [3, 4]))
    assert {r.side: (r.n, r.first_key) for r in align.report(left, right, "id").collect()} == {"both": (1, 3), "left_only": (2, 1), "right_only": (1, 4)}
    a, b = (spark.createDataFrame(x, "key string, value string") for x in ([("a", "1"), ("b", None)], [("a", "2"), ("b", None), ("c", "3")]))
    assert {r.key: r.differs for r in validate.manifest_difference(a, b).collect()} == {"a": True, "b": False, "c": True}


def grams_by_hand(text):
    words = re.findall("[a-z0-9à-öø-ÿ]+", text.lower())
    out = [f"w {w}" for w in words] + [f"w {a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for word in text.lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            if len(padded) <= n:
                out.append("c" + padded)
                break
            out += ["c" + padded[i : i + n] for i in range(len(padded) - n + 1)]
    return Counter(out)


def test_grams(spark):
    texts = [(0, "A bc  déf,\n ghijkl x"), (1, ""), (2, None), (3, "ab"), (4, "a")]
    found = defaultdict(Counter)
    for r in lexical.gram_counts(spark.createDataFrame(texts, "id long, t string"), "id", F.col("t")).collect():
        found[r.id][r.term] = r.tf
    assert dict(found) == {i: grams_by_hand(t) for i, t in texts if t}


def test_vectors_and_models_leave_no_term_out(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" strong" if i % 2 else " weak"), i % 2, i // 4 % 3) for i in range(60)] + [(99, "", 0, 0)]
    docs = spark.createDataFrame(rows, "id long, t string, y int, f long")
    places = lexical.vocabulary(docs, "id", F.col("t"))
    vectors = lexical.vectors(docs, "id", F.col("t"), places)
    counts = {i: grams_by_hand(t) for i, t, *_ in rows}
    df = Counter(x for c in counts.values() for x in c)
    terms = {r.at: r.term for r in places.collect()}
    assert sorted(terms) == list(range(len(terms))) and set(terms.values()) == {x for x, n in df.items() if n >= 2}
    for r in vectors.collect():
        raw = {x: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x, n in counts[r.id].items() if df[x] >= 2}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert {terms[int(i)]: round(w, 9) for i, w in zip(r.x.indices, r.x.values, strict=True)} == {x: round(w / norm, 9) for x, w in raw.items()}
    known = vectors.join(docs.select("id", "y", "f"), "id")
    model, best = lexical.refitted(known, places, "y", 3)
    assert all(r.term[1:].strip() in {1: "strong", 0: "weak"}[r["class"]] for r in best.where("rank = 1").collect())
    assert model.numFeatures == len(terms)
    unseen = lexical.vectors(spark.createDataFrame([(1, "something strong"), (2, "weak"), (3, "zzz")], "id long, t string"), "id", F.col("t"), places)
    told = {r.id: r.probability for r in lexical.predicted(model, unseen).collect()}
    assert told[2] < 0.5 < told[1] and told[2] < told[3] < told[1]
    nested = spark.createDataFrame([(i, f, k, i % 2) for i, _, _, f in rows for k in range(3) if k != f], "id long, fold long, held long, inner_fold long")
    scored = lexical.out_of_fold(docs, nested, "y", "id", F.col("t"), grid=((0.01, True), (0.1, False))).collect()
    assert len(scored) == 61 and sum((r.probability > 0.5) == bool(r.y) for r in scored) >= 55


def test_features_know_training_texts_alone(spark):
    """Every set's terms, weights and vectors are those of its own texts; what only held texts have is in none of them."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)) + (" planted secret" if i % 3 == 1 else "") + (" inner" if i % 3 == 0 and i // 3 % 2 else ""), i % 2) for i in range(36)] + [(99, "", 1), (100, None, 0)]
    docs = spark.createDataFrame(rows, "id long, t string, y int")
    plan = [(i, k, i // 3 % 2) for i, *_ in rows for k in range(3) if i % 3 != k]
    counts = lexical.gram_counts(docs, "id", F.col("t"))
    limits = lexical.Limits(2, 0.9, 40)
    terms = lexical.training_terms(counts, spark.createDataFrame(plan, "id long, held long, inner_fold long"), "id", limits)
    found = defaultdict(dict)
    for r in terms.collect():
        found[r.held, r.without][r.term] = r.idf
    grams = {i: grams_by_hand(t or "") for i, t, _ in rows}
    expected = {}
    for k in range(3):
        for j in (-1, 0, 1):
            ids = [i for i, held, inner in plan if held == k and inner != j]
            df, tf = Counter(x for i in ids for x in grams[i]), sum((grams[i] for i in ids), Counter())
            kept = [x for x, n in df.items() if 2 <= n <= 0.9 * len(ids)]
            kept = [x for kind in "wc" for x in sorted((x for x in kept if x[0] == kind), key=lambda x: (-tf[x], x))[:40]]
            expected[k, j] = {x: math.log((1 + len(ids)) / (1 + df[x])) + 1 for x in kept}
    assert {s: {x: round(v, 9) for x, v in t.items()} for s, t in found.items()} == {s: {x: round(v, 9) for x, v in t.items()} for s, t in expected.items()}
    planted = [x for t in found.values() for x in t if x in ("w planted", "w secret", "w planted secret")]
    assert planted and not any("planted" in x or "secret" in x for s in ((1, -1), (1, 0), (1, 1)) for x in found[s])
    assert any(x.startswith("w inner") for x in found[1, 0]) and not any("inner" in x for x in found[1, 1] if x[0] == "w")
    sizes = Counter()
    for r in lexical.training_vectors(counts, terms, docs, "id").collect():
        raw = {x: (1 + math.log(n)) * expected[r.held, r.without][x] for x, n in grams[r.id].items() if x in expected[r.held, r.without]}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1
        assert sorted(round(w, 9) for w in r.x.values) == sorted(round(w / norm, 9) for w in raw.values())
        sizes[r.held, r.without] += 1
    assert set(sizes.values()) == {len(rows)} and len(sizes) == 9


def test_folds_spread_labels_and_nest(spark):
    rng = random.Random(6)
    rows, i = [], 0
    for g in range(200):
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            rows.append((i, g, "E" if g % 4 else "C"))
            i += 1
    members = spark.createDataFrame(rows, "id long, group long, label string")
    fold = {r.group: r.fold for r in graph.folds(members, 5, "s", "label").collect()}
    per = Counter((fold[g], x) for _, g, x in rows)
    for x in "EC":
        sizes = [per[k, x] for k in range(5)]
        assert max(sizes) - min(sizes) <= 8
    nested = graph.nested_folds(members, 5, 4, "s", "label").collect()
    assert all(r.fold == fold[r.group] and r.held != r.fold for r in nested)
    assert len({(r.group, r.held) for r in nested}) == len(nested) == 200 * 4
    for k in range(5):
        assert {r.inner_fold for r in nested if r.held == k} == {0, 1, 2, 3}


def test_numbers_by_parts(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(40)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, k string, t long")
    found = {r.id: r.n for r in order.numbered(frame, ["k"], F.floor(F.col("t") / 7), ["t", "id"], "n").collect()}
    whole = {r.id: r.n for r in order.indexed(frame, ["t", "id"], "n").collect()}
    ranked = sorted(rows, key=lambda r: (r[2], r[0]))
    assert whole == {r[0]: n for n, r in enumerate(ranked)}
    for k in ("a", "b", None):
        assert [found[i] for i, x, _ in ranked if x == k] == list(range(sum(x == k for _, x, _ in rows)))


@pytest.mark.parametrize("counts", [[6, 6, 3] + [1] * 15, [5, 5, 4, 4, 3, 2, 2], [7, 6, 6, 6, 1], [4, 3, 3, 3], [3], [1, 1, 1], [9, 1], [2, 2, 2, 1, 1], [8, 7, 5, 3, 3, 3, 1]])
def test_gap_schedule(spark, counts):
    rows = [(1000 * k + i, None if k == 1 else f"k{k}") for k, n in enumerate(counts) for i in range(n)]
    placed = order.gap_schedule(spark.createDataFrame(rows, "id long, k string"), "k", "id", 2).collect()
    total = sum(counts)
    assert sorted(r.pos for r in placed) == list(range(1, total + 1)) and sorted(r.id for r in placed) == sorted(i for i, _ in rows)
    places = defaultdict(list)
    for r in sorted(placed, key=lambda r: r.pos):
        places[r.k].append(r.pos)
    least = min((b - a for p in places.values() for a, b in zip(p, p[1:], strict=False)), default=total)
    assert least == order.widest_gap({str(k): n for k, n in enumerate(counts)})


def test_demos_take_turns(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("AB"), f"r{rng.randrange(5)}", "w " * rng.randrange(300)) for i in range(80)]
    targets = spark.createDataFrame([(3, "r4")], "id long, ref string")
    found = order.demo_round(spark.createDataFrame(rows, "id long, label string, ref string, t string"), "label", "ref", "id", F.size(F.split(F.trim("t"), " ")), 2, "s", targets).collect()
    used, expected = set(), []
    key = lambda i: hashlib.sha256(f"s|{i}".encode()).hexdigest()
    for turn in (1, 2):
        for x in "AB":
            free = sorted((key(i), i, ref) for i, label, ref, t in rows if label == x and ref not in used | {"r4"} and i != 3 and len(t.split(" ")) - (t != "") <= 160)
            if free:
                used.add(free[0][2])
                expected.append((free[0][1], x, free[0][2], turn))
    assert sorted(map(tuple, found)) == sorted(expected) and len({r.ref for r in found}) == len(found)


def test_strict_alignment(spark):
    left = spark.createDataFrame([(2, "b"), (1, "a")], "id long, x string")
    right = spark.createDataFrame([(1, "c"), (2, "d")], "id long, x string")
    assert [tuple(r) for r in align.strict(left, right, "id").collect()] == [(1, "a", "c"), (2, "b", "d")]
    placed = left.withColumn("pos", 3 - F.col("id"))
    assert [r.id for r in align.in_order(placed, right, "id", "pos").collect()] == [2, 1]
    for other, told in ([(1, "c")], "missing on the right: 2"), ([(1, "c"), (2, "d"), (3, "e")], "missing on the left: 3"), ([(1, "c"), (2, "d"), (2, "e")], "repeated: 2"):
        with pytest.raises(align.Misaligned, match=told):
            align.strict(left, spark.createDataFrame(other, "id long, x string"), "id")
    with pytest.raises(Exception, match="more than half"):
        align.shifted_partners(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, g string"), "id", "g").collect()


def test_integers_of_any_form(spark):
    raw = ["8", "8.0", '"8"', "8.5", "-8.5", "true", "null", '"x"', "08", "8e1", '" 9 "', None, "1" * 30]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, r string")
    got = lambda mode: [r.k for r in rows.select("i", validate.lax_integer(F.col("r"), mode).alias("k")).orderBy("i").collect()]
    assert got("json") == [8] + [None] * 12
    assert got("whole")[:12] == [8, 8, 8, None, None, None, None, None, None, 80, 9, None]
    assert got("truncate")[:12] == [8, 8, 8, 8, -8, None, None, None, None, 80, 9, None]


def test_faults_of_predictions(spark):
    rows = [
        ('{"id": "a", "label": " Neutral ", "start": null, "end": null}', []),
        ('{"id": "a", "label": "entailment", "start": 1, "end": 4}', []),
        ('{"id": "a", "label": "entailment", "start": 1, "end": 5}', ["bounds"]),
        ('{"id": "a", "label": "entailment", "start": 3, "end": 2}', ["bounds"]),
        ('{"id": "a", "label": "entailment", "start": 0, "end": 2}', ["bounds"]),
        ('{"id": "a", "label": "entailment", "start": 1.0, "end": 2}', ["integers"]),
        ('{"id": "a", "label": "entailment", "start": "1", "end": 2}', ["integers"]),
        ('{"id": "a", "label": "entailment", "start": true, "end": 2}', ["integers"]),
        ('{"id": "b", "label": "odd", "start": 1, "end": 2}', ["id", "label"]),
        ('{"id": "a", "label": "neutral", "start": 1, "end": null}', ["neutral_span"]),
        ('{"id": "a", "label": "neutral"}', ["keys"]),
        ("[1]", ["json"]),
        (None, ["json"]),
    ]
    found = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string").select("i", validate.prediction_faults(F.col("r"), F.lit("a"), F.lit(4)).alias("f")).orderBy("i").collect()
    assert [r.f for r in found] == [f for _, f in rows]


def test_counts_and_memberships(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, lang string")
    expected = spark.createDataFrame([("a", 1), ("b", 2)], "lang string, n long")
    assert sorted(map(tuple, validate.count_differences(docs, "lang", expected).collect()), key=repr) == sorted([("a", 2, 1, 1), ("b", 0, 2, -2), (None, 3, 3, 0)], key=repr)
    have = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "id long, split string")
    want = spark.createDataFrame([(1, "y"), (2, "x"), (3, "x")], "id long, split string")
    assert sorted(map(tuple, validate.membership_faults(have, want, "id", "split").collect())) == [("absent", 1, "y"), ("absent", 3, "x"), ("several", 2, "x"), ("unlisted", 1, "x"), ("unlisted", 2, "y")]


def test_mentions_of_names(spark):
    docs = spark.createDataFrame([(1, "Ann of the hill"), (2, "Anna, of  the"), (3, "(Ann)"), (4, None), (5, "of the_hill"), (6, "xAnn of the.")], "id long, t string")
    names = spark.createDataFrame([("Ann",), ("of the",)], "name string")
    assert sorted(map(tuple, align.mentions(docs, names, "id", "t", "name").collect())) == [(1, "Ann"), (1, "of the"), (3, "Ann"), (6, "of the")]


def test_vocabulary_leaves_no_table_of_all_grams(spark):
    import os

    from kappaloom.sources.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    texts = spark.createDataFrame([(1, "one two"), (2, "two one"), (3, "three")], "id long, t string")
    places = lexical.vocabulary(texts, "id", F.col("t"))
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"terms"}
    assert {r.term: round(r.idf, 9) for r in places.collect()}["w one"] == round(math.log(4 / 3) + 1, 9)


def test_terms_of_cells_equal_those_of_texts(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} word{i % 3} other{i % 7} all") for i in range(40)], "id long, t string")
    plan = spark.createDataFrame([(i, held, (i // 3) % 2) for i in range(36) for held in range(3) if i % 3 != held], "id long, held long, inner_fold long")
    marked = docs.join(lexical.plan_cells(plan, "id", "cell"), "id", "left")
    counts = lexical.gram_counts(marked, "id", F.col("t"), ("cell",))
    assert counts.select("cell").distinct().count() == 7  # six kinds of texts, and those without a plan
    limits = lexical.Limits(2, 0.9, 25)
    plain, by_cell = (sorted(map(tuple, lexical.training_terms(counts.select("id", "term", "tf"), plan, "id", limits).collect())), sorted(map(tuple, lexical.training_terms(counts, plan, "id", limits, "cell").collect())))
    assert plain == by_cell and len(plain) > 100
    terms = spark.createDataFrame(plain, "held long, without long, term string, idf double")
    one, other = ({(r.held, r.without, r.id): r.x for r in lexical.training_vectors(counts, terms, docs, "id", bounded).collect()} for bounded in (False, True))
    assert one.keys() == other.keys() and all(one[k].toArray() == pytest.approx(other[k].toArray()) for k in one)
