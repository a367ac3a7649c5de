import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kappaloom.functions import hashing, labels, numeric, spans, text
from kappaloom.plans.texts import word_changes

SPAN = "s1 int, e1 int, s2 int, e2 int"


def brute_scores(s1, e1, s2, e2):
    a = set(range(s1, e1 + 1)) if s1 is not None else set()
    b = set(range(s2, e2 + 1)) if s2 is not None else set()
    if not a and not b:
        return 1.0, 1.0, True
    if not a or not b:
        return 0.0, 0.0, False
    return 2 * len(a & b) / (len(a) + len(b)), len(a & b) / len(a | b), a == b


def test_span_scores_equal_sets(spark):
    bounds = [(None, None), (1, 1), (1, 5), (3, 4), (5, 9), (7, 7), (6, 12)]
    rows = [(*a, *b) for a in bounds for b in bounds]
    found = spark.createDataFrame(rows, SPAN).select("*", spans.scores(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("s")).collect()
    for r in found:
        f1, iou, exact = brute_scores(r.s1, r.e1, r.s2, r.e2)
        assert r.s.token_f1 == pytest.approx(f1) and r.s.iou == pytest.approx(iou) and r.s.exact == exact
        assert r.s.iou <= r.s.token_f1 and (not r.s.exact or r.s.iou == 1)


TEXTS = ["", "  ", "a", " a b ", "x y z", "a\x1cb\x1fc\x85d", "déjà é \U0001f642 fin", "\n\nab\tcd\n", "no​break"]


def test_tokens_equal_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "id int, t string")
    arrays = {r.id: [tuple(x) for x in r.k] for r in rows.select("id", text.tokens("t").alias("k")).collect()}
    flat = {}
    for r in text.token_rows(rows, "id", "t").collect():
        flat.setdefault(r.id, []).append((r.token_id, r.text, r.char_start, r.char_end))
    for i, t in [*enumerate(TEXTS), (99, "")]:
        expected = [(k, m[0], m.start(), m.end()) for k, m in enumerate(re.finditer(r"\S+", t), 1)]
        assert arrays[i] == expected and sorted(flat.get(i, [])) == expected


def test_token_spans_equal_overlap(spark):
    rows = [(i, t, a, b) for i, t in enumerate(TEXTS) for a in range(len(t) + 1) for b in range(a, len(t) + 1)]
    frame = spark.createDataFrame(rows, "id int, t string, a int, b int")
    met = frame.select("*", text.token_span(F.col("t"), F.col("a"), F.col("b")).alias("s"), spans.covering_tokens(text.tokens("t"), F.col("a"), F.col("b")).alias("c"), spans.trimmed(F.col("t"), F.col("a"), F.col("b")).alias("w")).collect()
    for r in met:
        ids = [k for k, m in enumerate(re.finditer(r"\S+", r.t), 1) if m.end() > r.a and m.start() < r.b]
        expected = (ids[0], ids[-1]) if ids and r.a < r.b else (None, None)
        assert tuple(r.s) == expected
        if r.a < r.b:
            assert tuple(r.c) == expected
        part = r.t[r.a : r.b]
        if part.strip():
            assert (r.w.start, r.w.end) == (r.a + len(part) - len(part.lstrip()), r.b - len(part) + len(part.rstrip()))


def test_rendering_and_keys(spark):
    row = spark.createDataFrame([("un  deux trois", "Straße  ﬁn", "Ann and Anna, Ann.", "é")], "a string, b string, c string, d string")
    rendered = text.numbered(text.words(F.col("a")))
    out = row.select(
        rendered.alias("r"),
        text.numbers(rendered).alias("n"),
        text.numbers(F.lit("[1] a\n[3] b")).alias("gap"),
        text.span_text(text.words(F.col("a")), F.lit(2), F.lit(3)).alias("s"),
        text.normalised("b").alias("k"),
        text.folded(F.col("b")).alias("f"),
        text.replace_word(F.col("c"), "Ann", "Eve$1").alias("w"),
        text.replace_word(F.col("c"), "An", "Eve").alias("none"),
        text.nfc("d").alias("d"),
        text.mentions(F.col("c"), ["ANNA"]).alias("m"),
    ).first()
    assert out.r == "[1] un\n[2] deux\n[3] trois" and out.n == [1, 2, 3] and out.gap is None
    assert out.s == "deux trois" and out.k == "strasse fin" and out.f == "straße ﬁn"
    assert out.w == "Eve$1 and Anna, Eve$1." and out.none is None and out.d == "é" and out.m


def test_labels_and_numbers(spark):
    rows = spark.createDataFrame([(" Entails", [0.2, 0.5, 0.5]), ("NEUTRE", [0.3, 0.3, 0.4]), ("odd ", [1.0, 0.0, 0.0])], "l string, p array<double>")
    out = rows.select(labels.normalised(F.col("l")).alias("l"), labels.most_probable(F.col("p")).alias("m"), labels.softmax(F.col("p")).alias("s"), labels.total_variation(F.col("p"), F.array(*[F.lit(1.0 / 3)] * 3)).alias("t")).collect()
    assert [r.l for r in out] == ["entailment", "neutral", "odd"]
    assert [r.m for r in out] == ["contradiction", "neutral", "entailment"]
    assert all(sum(r.s) == pytest.approx(1) for r in out) and out[2].t == pytest.approx(2 / 3)
    p = spark.createDataFrame([(3, 9), (0, 0), (2, 4), (1500, 1500), (0, 2000)], "b long, c long").select(numeric.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    assert [r.p for r in p][:3] == [pytest.approx(0.14599609375), 1.0, pytest.approx(0.6875)]
    assert p[3].p == 1.0 and p[4].p == pytest.approx(0, abs=1e-300)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_nearest_rank(spark, values, p):
    frame = spark.createDataFrame([(0, v) for v in values], "g int, v int")
    expected = sorted(values)[round((len(values) - 1) * p)]
    assert numeric.nearest_ranks(frame, "v", {"x": p}, "g").first().x == expected


def test_fingerprint_ignores_order(spark):
    rows = [(i, f"t{i % 7}") for i in range(50)]
    prints = {hashing.fingerprint(spark.createDataFrame(x, "i int, t string").repartition(n), F.concat_ws("|", "i", "t")).first() for x, n in ((rows, 1), (rows[::-1], 3))}
    assert len(prints) == 1
    other = hashing.fingerprint(spark.createDataFrame(rows[1:], "i int, t string"), F.concat_ws("|", "i", "t")).first()
    assert other not in prints


PIECES = st.lists(st.sampled_from(["a", "é", " ", "\xa0", "\x1c", "\u3000", "漢", "🙂", "\n", "word"]), max_size=14).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), PIECES), max_size=6))
def test_tokens_of_any_texts(texts):
    found = text.token_lists(pa.array(texts, pa.string())).to_pylist()
    assert [[t["text"] for t in row] for row in found] == [(x or "").split() for x in texts]
    for row, x in zip(found, texts, strict=True):
        assert [t["token_id"] for t in row] == list(range(1, len(row) + 1))
        assert all(x[t["char_start"] : t["char_end"]] == t["text"] for t in row)


def test_token_rows(spark):
    rows = [(1, " a bc "), (2, None), (3, "x" * 100000 + " y"), (1, "d")]
    found = sorted(map(tuple, text.token_rows(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()))
    assert found == [(1, 1, "a", 1, 2), (1, 1, "d", 0, 1), (1, 2, "bc", 3, 5), (3, 1, "x" * 100000, 0, 100000), (3, 2, "y", 100001, 100002)]


def test_word_changes_rebuild_the_text(spark):
    rng = random.Random(2)
    pairs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(12))), " ".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for i in range(30)] + [(99, None, "a")]
    rows = spark.createDataFrame(pairs, "i int, a string, b string").select("i", word_changes("a", "b").alias("e")).collect()
    edits = {r.i: r.e for r in rows}
    for i, a, b in pairs:
        x, y, out, at = (a or "").split(), (b or "").split(), [], 0
        for e in edits[i]:
            assert e.tag in ("replace", "insert", "delete") and x[e.a_from : e.a_to] != y[e.b_from : e.b_to]
            out += x[at : e.a_from] + y[e.b_from : e.b_to]
            at = e.a_to
        assert out + x[at:] == y


def test_ids_and_maps(spark):
    rows = spark.createDataFrame([(1, " 12 "), (2, "doc-0003"), (3, " "), (4, "other"), (5, "123456")], "i long, t string")
    found = rows.select("i", labels.looked_up_id(F.col("t"), "DOC-", 4).alias("id"), labels.record_id(F.col("t"), position=F.col("i")).alias("r")).orderBy("i").collect()
    assert [(r.id, r.r) for r in found] == [("DOC-0012", "12"), ("DOC-0003", "doc-0003"), (None, "row-3"), ("other", "other"), ("DOC-123456", "123456")]
    ids = spark.createDataFrame([("DOC-0009",), ("DOC-x",), ("OTHER-5000",), ("DOC-12345",)], "id string")
    assert ids.agg(labels.next_id(F.col("id"), "DOC-", 4)).first()[0] == "DOC-12346"
    assert ids.limit(0).agg(labels.next_id(F.col("id"), "DOC-", 4)).first()[0] == "DOC-0001"
    assert spark.range(1).select(labels.probability_map(F.array(*map(F.lit, (0.2, 0.3, 0.5)))).alias("m")).first().m == {"entailment": 0.2, "contradiction": 0.3, "neutral": 0.5}


def test_tokens_do_not_depend_on_what_is_laid_out_at_once(monkeypatch):
    texts = pa.array(["a b", None, "", " ", "éé  ü\n", "x" * 40 + " y", "z"])
    whole = text.token_lists(texts)
    laid, inner = [], text._token_lists
    monkeypatch.setattr(text, "_token_lists", lambda part: laid.append(len(part)) or inner(part))
    monkeypatch.setattr(text, "LAID_OUT", 6)
    assert text.token_lists(texts).to_pylist() == whole.to_pylist() and laid == [4, 1, 1, 1]
    assert [len(t) for t in whole.to_pylist()] == [2, 0, 0, 0, 2, 2, 1] and text.token_lists(texts.slice(0, 0)).to_pylist() == []
