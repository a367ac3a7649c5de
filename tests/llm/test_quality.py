import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kappaloom.llm import kneser_ney as kn

DOCS = "doc_id long, text string, lang string, row string, keep string, block string"
LABELS = "doc_id long, quality int, toxic int, lang string"


def symbols(text):
    raw = (kn.BEGIN * 3 + kn.normal(text)[0]).encode("utf-16-le", "surrogatepass")
    return [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]


def brute_model(trained):
    """Interpolated modified Kneser-Ney probabilities of 4-grams of symbols, written out: the last symbol of a tuple after the others."""
    counts = {4: Counter()}
    for text in trained:
        s = symbols(text)
        counts[4].update(zip(s, s[1:], s[2:], s[3:], strict=False))
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    contexts = {}
    for order, table in counts.items():
        d = kn.discounts(Counter(table.values()))
        for g, n in table.items():
            total, left = contexts.get((order, g[:-1]), (0, 0.0))
            contexts[order, g[:-1]] = total + n, left + d[min(n, 3) - 1]
    cuts = {order: kn.discounts(Counter(table.values())) for order, table in counts.items()}

    def p(g):
        if not g:
            return 1 / kn.SYMBOLS
        order = len(g)
        lower = p(g[1:])
        if (order, g[:-1]) not in contexts:
            return lower
        total, left = contexts[order, g[:-1]]
        n = counts[order][g]
        return ((n - cuts[order][min(n, 3) - 1] if n else 0) + left * lower) / total

    return p


def corpus():
    rng = random.Random(2)
    small = ["of", "the", "as", "in", "word", "another", "threshold", "nothing", "stone", "river", "winter", "morning", "größe", "été"]
    small += [a + b for a in ("light", "dark", "rain", "snow", "field") for b in ("fall", "house", "ward", "ing", "man")]

    def sentence():
        words = [rng.choice(small) for _ in range(rng.randrange(5, 14))]
        return words[0].capitalize() + " " + " ".join(words[1:]) + "."

    rows = [(i, " ".join(sentence() for _ in range(rng.randrange(3, 20))), "en" if i % 3 else "fr") for i in range(200)]
    junk = [(1000 + i, t, "en") for i, t in enumerate(["SHOUT!! THE MORNING!! " * 60, "again " * 80, "a%%% b$$$ c&&& " * 30, "of | river | as | word | " * 40, "zxq vvk qqx jjw " * 30])]
    odd = [(2000, None, "en"), (2001, " \n", None), (2002, "Nothing of the word as threshold in another.", None), (2003, " ".join(sentence() for _ in range(3000)), "en"), (None, "The stone of winter in another river.", "xx")]
    return rows, junk, odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6), st.integers(1, 5))
def test_keys_of_parts(texts, chunk):
    found = []
    for owners, parts in kn.chunks(iter(texts), chunk):
        assert len(owners) == len(parts)
        found += kn.keys(parts).view(np.uint64).tolist()
    expected = []
    for text in texts:
        raw = (kn.BEGIN * 3 + text).encode("utf-16-le", "surrogatepass")
        expected += [int.from_bytes(raw[i : i + 8], "little") for i in range(0, len(raw) - 6, 2)]
    assert found == expected


def test_tallies():
    rng = np.random.default_rng(1)
    tally, expected = kn.Tally(), Counter()
    for weight in (0, 1, 1):
        found = rng.integers(-50, 50, 1000)
        tally.add(found, weight)
        for x in found.tolist():
            expected[x] += weight
    assert tally.merge() == len(expected)
    assert dict(zip(tally.keys.tolist(), tally.counts.tolist(), strict=True)) == expected


def test_probabilities_equal_brute_force(spark):
    rows, junk, _ = corpus()
    trained = [t for _, t, _ in rows[:40]]
    counts = Counter()
    for text in trained:
        counts.update(kn.keys(list(kn.pieces(kn.normal(text)[0]))).tolist())
    model, p = kn.Model(spark.createDataFrame(list(counts.items()), "g long, n long")), brute_model(trained)
    asked = {}
    for text in [trained[0], junk[2][1], "née 🙂"]:
        s = symbols(text)
        asked |= dict(zip(kn.keys(list(kn.pieces(kn.normal(text)[0]))).tolist(), zip(s, s[1:], s[2:], s[3:], strict=False), strict=True))
    found = model.answer(spark.createDataFrame([(g,) for g in asked], "g long")).collect()
    assert len(found) == len(asked)
    for r in found:
        assert math.isclose(math.exp(r.logp), p(asked[r.g]), rel_tol=1e-9)
    # the probabilities of what follows a context sum to 1
    seen = {g[-1] for g in asked.values()} | {x for t in trained for x in symbols(t)}
    for c in list(asked.values())[:20]:
        rest = p((*c[:3], 0xFFFF))
        assert math.isclose(sum(p((*c[:3], x)) for x in seen) + rest * (kn.SYMBOLS - len(seen)), 1, rel_tol=1e-6)


@pytest.mark.parametrize("limits", [None, (3, 50, 10)])
def test_verdicts(spark, monkeypatch, limits):
    if limits:
        for name, value in zip(("BLOCK_ROWS", "CHUNK", "HELD"), limits, strict=True):
            monkeypatch.setattr(kn, name, value)
    rows, junk, odd = corpus()
    docs = frame(spark, rows + junk + odd + rows[:1]).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0, None) for i, *_ in rows[:160]] + [(1000, 0, 0, None), (100, 1, 1, None), (101, None, 0, None), (None, 1, 0, None), (3, 1, 0, None)], LABELS)
    found = kn.judge(docs, labels).collect()
    assert len(found) == len(rows + junk + odd) + 1
    by_id = {r.doc_id: r for r in found}
    assert not any(by_id[i].keep for i, *_ in junk)
    assert sum(by_id[i].keep for i, *_ in rows) >= 190
    assert by_id[2000].perplexity is None and not by_id[2000].keep and not by_id[2001].keep
    assert by_id[2002].keep and by_id[2003].keep and by_id[None].low is not None
    # keep follows from what is published
    assert all(r.keep == (r.n_chars > 0 and r.low <= r.level <= r.high) for r in found)
    # the perplexity is that of the written-out model of the texts that are not held out
    trusted = {t for i, t, _ in rows[:160] if i not in (100, 101)}
    prints = spark.createDataFrame([(t,) for t in trusted], "text string").selectExpr("text", f"pmod(xxhash64(xxhash64(text), 1), {kn.HOLD_OUT}) = 0 AS held").collect()
    p = brute_model([r.text for r in prints if not r.held])
    for i in (5, 1001, 2003):
        text = next(t for d, t, _ in rows + junk + odd if d == i)
        s = symbols(text)
        nll = -sum(math.log(p(g)) for g in zip(s, s[1:], s[2:], s[3:], strict=False))
        assert by_id[i].n_chars == len(" ".join(text.split()))
        assert math.isclose(by_id[i].perplexity, math.exp(nll / by_id[i].n_chars), rel_tol=1e-5)
    kept = kn.kept(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in found if r.keep), key=repr)


def test_quantiles_equal_brute_force(spark):
    rng = random.Random(3)
    values = [(rng.choice(["en", "en", "en", "fr", None]), rng.randrange(100)) for _ in range(300)] + [("de", 50)]
    found = {r.tongue: (r.a, r.b) for r in kn._quantiles(spark.createDataFrame(values, "lang string, x long"), {"a": 0.01, "b": 0.9}).collect()}
    assert set(found) == {"en", "fr", "de", ""}
    for tongue in found:
        own = [x for lang, x in values if lang == tongue]
        weights = Counter({x: n * kn.POOLED for x, n in Counter(x for _, x in values).items()})
        for x in own:
            weights[x] += len(values)
        for share, got in zip((10, 900), found[tongue], strict=True):
            upto = 0
            for x in sorted(weights):
                upto += weights[x]
                if 1000 * upto >= share * sum(weights.values()):
                    break
            assert got == x


def test_quantiles_of_some_values_equal_those_of_a_table_of_them(spark):
    rng = random.Random(4)
    values = [(rng.choice(["en", "en", "fr", None]), rng.randrange(100), rng.random() < 0.3) for _ in range(200)] + [("de", 50, False), ("nl", 99, None)]
    frame = spark.createDataFrame(values, "lang string, x long, held boolean")
    both = {r.tongue: (r.low, r.high) for r in kn._quantiles(frame, {"low": 0.2, "high": 0.7}, {"high": "held"}).collect()}
    low = {r.tongue: r.low for r in kn._quantiles(frame, {"low": 0.2}).collect()}
    high = {r.tongue: r.high for r in kn._quantiles(frame.where("held"), {"high": 0.7}).collect()}
    assert set(high) == {"en", "fr", ""} and both == {t: (x, high.get(t, high[""])) for t, x in low.items()}
    assert {r.high for r in kn._quantiles(frame.where("lang = 'de'"), {"low": 0.2, "high": 0.7}, {"high": "held"}).collect()} == {None}


def test_without_trusted_or_documents(spark):
    rows, *_ = corpus()
    docs = frame(spark, rows[:5])
    none = spark.createDataFrame([], LABELS)
    assert all(r.keep and r.low is None for r in kn.judge(docs, none).collect())
    assert kn.kept(docs, none).count() == 5
    assert kn.judge(docs.limit(0), none).count() == 0 and kn.kept(docs.limit(0), none).columns == docs.columns
