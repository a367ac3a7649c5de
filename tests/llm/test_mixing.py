import math
import random
import re
from collections import Counter

import duckdb
import pytest

from kappaloom.llm import mixing

DOCS = "doc_id long, text string, source string, pass string, weight string"


def corpus():
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 400), "big" if i % 3 else rng.choice(["a", "b", "c"])) for i in range(300)]
    return rows + [(900, None, "big"), (901, " \n", "empty"), (902, "one two", None), (None, "no id here", "a"), (5, rows[5][1], rows[5][2])]


def n_tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def test_weights_and_quotas(spark):
    rows = corpus()
    totals = Counter()
    for _, text, source in rows:
        totals[source] += n_tokens(text)
    plan = {r.src: r for r in mixing.source_plan(mixing.counted(frame(spark, rows))).collect()}
    assert set(plan) == {"=big", "=a", "=b", "=c", ""}
    budget, e = sum(totals.values()), plan["=a"].exponent
    z = sum((t / budget) ** e for t in totals.values() if t)
    for source, r in ((("" if s is None else "=" + s), s) for s in totals if totals[s]):
        weight = (totals[r] / budget) ** e / z
        assert math.isclose(plan[source].weight, weight, abs_tol=1e-8)
        assert plan[source].quota / totals[r] <= mixing.REPEATS + 1e-3 or e == 1
    entropy = -sum(r.weight * math.log(r.weight) for r in plan.values())
    # the target is met, or a limit on repeats has raised the exponent above it
    most = max(p.quota / p.total for p in plan.values())
    assert math.isclose(entropy, mixing.ENTROPY * math.log(len(plan)), abs_tol=1e-6) or entropy < mixing.ENTROPY * math.log(len(plan)) and math.isclose(most, mixing.REPEATS, rel_tol=1e-2)


def test_entropy_is_met_where_no_limit_binds(spark):
    rows = [(i, "w " * (50 if i < 60 else 100), "s%d" % min(3, i // 20)) for i in range(400)]
    plan = mixing.source_plan(mixing.counted(frame(spark, rows)), repeats=None, entropy=0.9).collect()
    entropy = -sum(r.weight * math.log(r.weight) for r in plan)
    assert math.isclose(entropy, 0.9 * math.log(len(plan)), abs_tol=1e-6) and 0 < plan[0].exponent < 1


@pytest.mark.parametrize("budget", [None, 500, 200000])
def test_draws(spark, budget):
    rows = corpus()
    source = frame(spark, rows)
    plan = {r.src: r for r in mixing.source_plan(mixing.counted(source), budget, block_tokens=3000).collect()}
    drawn = mixing.mixture(source, budget, block_tokens=3000).collect()
    by_source = {}
    for r in drawn:
        by_source.setdefault(("" if r.source is None else "=" + r.source), []).append(r)
    for src, p in plan.items():
        mine = sorted(by_source.get(src, []), key=lambda r: (r["pass"], r.slot, r.place))
        assert len({(r["pass"], r.slot, r.place) for r in mine}) == len(mine)
        got = sum(r.n_tokens for r in mine)
        assert p.quota <= got <= p.quota + 400
        full = Counter((r.doc_id, r.n_tokens) for r in mine if r["pass"] < p.passes)
        expected = Counter((i, n_tokens(t)) for i, t, s in rows if ("" if s is None else "=" + s) == src)
        assert full == Counter({k: n * p.passes for k, n in expected.items()} if p.passes else {})
    assert "=empty" not in by_source
    kept = mixing.drawn(source, budget, block_tokens=3000)
    assert kept.columns == source.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in drawn)


def test_equals_its_sql(spark):
    rows = [r for r in corpus() if r[0] is not None]
    found = mixing.mixture(frame(spark, rows)).toPandas()
    documents = frame(spark, rows).toPandas()  # noqa: F841
    expected = duckdb.sql(mixing.ORACLE).df()
    key = ["doc_id", "source", "n_tokens", "pass", "slot", "place", "weight", "exponent"]
    as_rows = lambda df: sorted((tuple(None if x != x else x for x in r) for r in df[key].itertuples(index=False)), key=repr)
    assert len(found) == len(expected)
    assert [tuple(map(str, r)) for r in as_rows(found)] == [tuple(map(str, r)) for r in as_rows(expected)]


def test_no_rows(spark):
    assert mixing.mixture(frame(spark, [])).count() == 0 and mixing.drawn(frame(spark, [])).columns == frame(spark, []).columns


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i}") for i in range(2000)]
    plan = mixing.source_plan(mixing.counted(frame(spark, rows))).collect()
    assert len(plan) == 2000 and math.isclose(sum(r.weight for r in plan), 1, abs_tol=1e-5)


def test_long_texts_ties_and_clashing_names(spark):
    names = ["doc_id", "text", "source", "row", "id", "of", "times", "print", "src", "_times", "_turn", "col"]
    rows = [(1, "word " * 50000, "a", *"xxxxxxxxx"), (2, "some words", "b", *"xxxxxxxxx"), (2, "some words", "b", *"yyyyyyyyy"), (2, "some more words", "b", *"zzzzzzzzz")]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    drawn = [mixing.drawn(docs.repartition(n), budget=100000).collect() for n in (1, 3)]
    assert Counter(map(tuple, drawn[0])) == Counter(map(tuple, drawn[1]))
    times = Counter((r.doc_id, r.n_tokens) for r in mixing.mixture(docs, budget=100000).collect())
    assert Counter((r.doc_id, len(r.text.split())) for r in drawn[0]) == times and times[1, 50000] >= 1
    assert len({r.row for r in drawn[0] if r.text == "some words"}) == 1


def test_no_python_in_the_plan(spark):
    plan = mixing.mixture(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
