import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kappaloom.llm import ngram_trie as nt
from kappaloom.llm.elias_fano import EliasFano, Trie

DOCS = "doc_id long, text string, at string, held string, block string, shard string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=80), st.sampled_from([1, 3, 1 << 9, 1 << 40]), st.integers(0, 99))
def test_sequence(values, divisor, seed):
    values = sorted(v // divisor for v in values)
    s = EliasFano.of(np.array(values, np.int64))
    n = len(values)
    if n:
        assert s.at(np.arange(n)).tolist() == values
    rng = random.Random(seed)
    x = [rng.choice([0, 1 << 46, *values, *(v + 1 for v in values), *(max(0, v - 1) for v in values)]) for _ in range(50)]
    start = [rng.randint(0, n) for _ in x]
    stop = [rng.randint(a, n) for a in start]
    expected = [next((i for i in range(a, b) if values[i] >= v), b) for v, a, b in zip(x, start, stop, strict=True)]
    assert s.successor(np.array(x), np.array(start), np.array(stop)).tolist() == expected


def test_sequence_is_compact():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 30, 100_000))
    assert sum(a.nbytes for a in EliasFano.of(values).arrays()) * 8 / len(values) < 2.7 + math.log2((1 << 30) / len(values))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4), st.integers(0, 60), st.integers(1, 1 << 40), st.integers(0, 99))
def test_trie_finds_what_it_holds_and_nothing_else(length, n, most, seed):
    rng = random.Random(seed)
    names = [rng.randrange(most) for _ in range(6)]
    grams = sorted({tuple(rng.choice(names) for _ in range(length)) for _ in range(n)})
    codes = np.arange(len(grams)) % 251
    made = Trie.of(np.array(grams, np.int64).reshape(-1, length), codes)
    read = Trie.from_buffer(np.frombuffer(made.to_bytes(), np.uint8))
    asked = grams + [tuple(rng.choice([*names, 7, most + 1]) for _ in range(length)) for _ in range(40)]
    for trie in (made, read):
        assert trie.find(np.array(asked, np.int64).reshape(-1, length)).tolist() == [grams.index(g) if g in grams else -1 for g in asked]
        assert trie.codes.tolist() == codes.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0AbCé\U0001f600", max_size=15)), max_size=6))
def test_words(texts):
    flat, counts = nt.words_of(pa.array(texts, pa.string()))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert flat.to_pylist() == [w for ws in expected for w in ws] and counts.tolist() == [len(ws) for ws in expected]


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows, order, quantised=True):
    """The model written out: recursion over contexts, counts in dictionaries."""
    counts, contexts = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            t = [""] * (order - 1) + tokens_of(text)
            for i in range(order - 1, len(t)):
                for k in range(1, order + 1):
                    counts[tuple(t[i - k + 1 : i + 1])] += 1
                    contexts[tuple(t[i - k + 1 : i])] += 1
    total, known = contexts[()], sum(len(g) == 1 for g in counts)

    def p(g):
        if len(g) == 1:
            return (counts[g] + 1) / (total + known + 1)
        c = contexts[g[:-1]]
        if not c:
            return p(g[1:])
        if not counts[g]:
            return p(g[1:]) * nt.prior(len(g)) / (c + nt.prior(len(g)))
        value = (counts[g] + nt.prior(len(g)) * p(g[1:])) / (c + nt.prior(len(g)))
        return 10 ** (-min(254, np.rint(-math.log10(value) * nt.STEPS)) / nt.STEPS) if quantised else value

    out = []
    for doc_id, text in rows:
        t = [""] * (order - 1) + tokens_of(text)
        grams = [tuple(t[i - order + 1 : i + 1]) for i in range(order - 1, len(t))]
        base = sum(math.log10(p(g[-1:])) for g in grams)
        out.append((doc_id, held(doc_id), len(grams), sum(counts[g[-1:]] > 0 for g in grams), total, round(base, 6), round(sum(math.log10(p(g)) for g in grams), 6)))
    return sorted(out, key=repr), p, counts


def corpus(n=60):
    rng = random.Random(8)
    vocabulary = ["the", "of", *(f"w{i}" for i in range(40))]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([3, 42])]) for _ in range(rng.randrange(1, 40)))) for i in range(n)]
    rows += [rows[3], rows[3], (None, "The of w1"), (None, "The of w1"), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "NEVER Seen\xa0before the of " * 3)]
    return rows + [(1004, " ".join(rng.choice(vocabulary) for _ in range(400))), (1005, "the " * 300), (1006, "\U0001f600 é the")]


@pytest.mark.parametrize(("order", "block", "shard", "hot"), [(2, 1 << 20, 1 << 21, 1 << 17), (2, 30, 40, 10), (3, 30, 100, 5), (4, 3, 300, 1)])
def test_scores_equal_brute_force(spark, order, block, shard, hot):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(3)
    found = nt.score_texts(frame, order, block_tokens=block, shard_rows=shard, hot=hot).collect()
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found), key=repr) == brute(rows, order)[0]


def test_probabilities_add_up_and_hold_out_matters():
    rows = corpus()
    _, p, counts = brute(rows, 3, quantised=False)
    words = [g[0] for g in counts if len(g) == 1]
    for context in [(), ("the",), ("of", "the"), ("", ""), ("", "w1"), ("never", "the")]:
        assert abs(sum(p((*context, w)) for w in words) + p((*context, "unknown")) - 1) < 1e-9


def test_no_rows_and_no_training_text(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)
    assert nt.score_texts(frame([])).collect() == []
    out = next(i for i in range(100) if held(i))
    assert [tuple(r) for r in nt.score_texts(frame([(out, "some words")])).collect()] == [(out, True, 3, 0, 0, 0.0, 0.0)]


def test_query_scores_by_trigrams(spark, tmp_path):
    from kappaloom.llm.queries import op12_trie

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in op12_trie(spark, str(tmp_path)).collect()), key=repr)
    assert found == brute(rows, 3)[0] != brute(rows, 2)[0]


def test_a_shard_leaves_no_file_once_it_has_answered(tmp_path):
    from kappaloom.llm.ngram_trie import _learnt, packed, unpacked

    rows = [packed(np.array([1, 1, 2]), np.array([3, 4, 4]), np.array([2, 0, 1]), np.array([2, 2, 1]), np.array([2, 0, 1])), packed(np.array([1]), np.array([4]), np.array([0]), np.array([2]), np.array([0]))]
    part = pa.table({"shard": [0, 0], "block": [7, 8], "payload": pa.array(rows, pa.binary())})
    told = _learnt(part, 2, 9, 5, f"file://{tmp_path}/tries")
    assert told.column("block").to_pylist() == [7, 8]
    assert [unpacked(x)[1].tolist() for x in told.column("payload").to_pylist()] == [[2, 0, 1], [0]]
    assert list((tmp_path / "tries").iterdir()) == []


@pytest.mark.parametrize("word", [5, 1 << 22, 1 << 40])
def test_a_shard_looks_up_an_n_gram_once_whoever_asks(tmp_path, monkeypatch, word):
    asked, find = [], Trie.find
    monkeypatch.setattr(Trie, "find", lambda self, grams: asked.append(grams.tolist()) or find(self, grams))
    # the words from the nearest on, then the last, by columns; trained here; the context's count; what is known of the last part
    first = nt.packed(*np.array([[word, 2, word], [3, 3, word], [4, word, 1]]), np.array([2, 0, 0]), np.array([3, 3, 7]), np.array([16, 0, 0]))
    second = nt.packed(*np.array([[word, word, 2], [word, 3, 3], [1, 4, word]]), np.array([3, 0, 0]), np.array([7, 3, 3]), np.array([32, 0, 0]))
    part = pa.table({"shard": [0] * 3, "block": [7, 8, 9], "payload": pa.array([first, second, first], pa.binary())})
    told = [[x.tolist() for x in nt.unpacked(p)] for p in nt._learnt(part, 3, 9, 5, f"file://{tmp_path}/tries").column("payload").to_pylist()]
    assert [sorted(x) for x in asked] == [sorted([[word, 3, 4], [2, 3, word], [word, word, 1]])]
    code = lambda n, c, lower: int(nt.quantised(np.array([(n + nt.prior(3) * 10 ** (-lower / nt.STEPS)) / (c + nt.prior(3))]))[0])
    one, other, absent = (code(4, 3, 16), 4), (code(3, 7, 32), 3), (nt.ABSENT, 0)
    assert [list(zip(*t, strict=True)) for t in told] == [[one, absent, other], [other, one, absent], [one, absent, other]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 200), st.integers(0, 1 << 45)), min_size=3, max_size=3), max_size=30))
def test_numbers_and_order_of_ids(rows):
    from kappaloom.llm.elias_fano import numbered

    grams = np.array(rows, np.int64).reshape(-1, 3).T
    names, places = numbered(grams)
    assert names.tolist() == sorted({x for r in rows for x in r}) and names[places].tolist() == grams.tolist()
    order, new = nt._sorted(grams)
    ordered = [rows[i] for i in order]
    assert sorted(order.tolist()) == list(range(len(rows))) and ordered == sorted(rows)
    assert new.tolist() == [not i or r != ordered[i - 1] for i, r in enumerate(ordered)]


@pytest.mark.parametrize("unpacked", [0, 1 << 40])
@pytest.mark.parametrize("most", [1 << 12, 1 << 20, 1 << 45])
def test_numbers_are_found_with_stretches_unpacked_and_without(monkeypatch, unpacked, most):
    monkeypatch.setattr("kappaloom.llm.elias_fano.UNPACKED", unpacked)
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, most, 3000))
    s = EliasFano.of(values)
    for places in (rng.integers(0, 3000, 500), np.array([2999]), np.arange(1200, 1300), np.zeros(0, np.int64)):
        assert s.at(places).tolist() == values[places].tolist()
    x = np.concatenate([values[::7], values[::7] + 1, [0, most + 5]])
    assert s.successor(x, np.zeros(len(x), np.int64), np.full(len(x), 3000)).tolist() == np.searchsorted(values, x).tolist()


def test_shuffle_files_are_given_up_inside_and_the_setting_comes_back(spark):
    from kappaloom.llm.shared import tidied

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), tidied(spark):
        assert spark.conf.get(key) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(key, None) == before
