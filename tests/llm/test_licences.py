import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kappaloom.llm import licences as lic

DOCS = "doc_id long, text string, labels string, score string"
PHRASES = {p: x for p, x in lic.BASE}
WORDS = st.lists(st.sampled_from(["cc", "by", "sa", "general", "public", "license", "all", "rights", "reserved", "é", "x1", "gnu", "GNU", "mit", "Permission is hereby granted, free of charge, to any person"]), max_size=25)


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(at, x) for p, x in PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
    return len(words), len(found), min((a for a, _ in found), default=None), max((a for a, _ in found), default=None), ",".join(sorted({x for _, x in found}))


@settings(max_examples=300, deadline=None)
@given(WORDS, st.sampled_from([" ", "-", ", ", "\n"]))
def test_base_places(words, by):
    text = by.join(words)
    for frequencies in ({}, {b"cc": 5, b"general": 9, b"reserved": 9}):
        assert lic.describe(lic.words_of(text), lic.Index(frequencies, 10))[:5] == brute(text)


NOTICE_WORDS = st.lists(st.sampled_from(sorted({" ".join(w.decode() for w in t.words[i : i + n]) for t in lic.TEMPLATES for i, n in ((0, 99), (0, 9), (t.key_at, len(t.key)), (max(0, t.key_at - 2), len(t.key) + 5))} | {"the", "license", "other words"})), max_size=6)


def score_by_hand(words, t, at, idf):
    """The share of a template's weight that stands around its key phrase, by looking for the nearest next pair that agrees."""
    got = set(range(t.key_at, t.key_at + len(t.key)))
    for step, i, j in ((-1, t.key_at - 1, at - 1), (1, t.key_at + len(t.key), at + len(t.key))):
        while True:
            pairs = [(a + b, a, b) for a in range(lic.SLACK + 1) for b in range(lic.SLACK + 1 - a)]
            pairs = [(n, a, b) for n, a, b in pairs if 0 <= i + step * a < len(t.words) and 0 <= j + step * b < len(words) and t.words[i + step * a] == words[j + step * b]]
            if not pairs:
                break
            _, a, b = min(pairs)
            got.add(i + step * a)
            i, j = i + step * (a + 1), j + step * (b + 1)
    return sum(idf[t.words[i]] for i in got) / sum(idf[w] for w in t.words) * len(got) / (len(got) + lic.HALF)


@settings(max_examples=150, deadline=None)
@given(NOTICE_WORDS, st.integers(0, 3))
def test_whole_result_equals_brute_force(parts, drop):
    words = lic.words_of(" ".join(parts))
    words = [w for i, w in enumerate(words) if not drop or i % 7 != drop]
    index = lic.Index({b"the": 100, b"license": 90, b"cc": 40}, 100)
    found = [(k, i) for k, t in enumerate(lic.TEMPLATES) for i in range(len(words)) if tuple(words[i : i + len(t.key)]) == t.key]
    labels = ",".join(sorted({lic.TEMPLATES[k].label for k, _ in found}))
    score = round(max((score_by_hand(words, lic.TEMPLATES[k], i, index.idf) for k, i in found), default=0.0), 6)
    told = lic.describe(words, index)
    assert told[5] == labels and abs(told[6] - score) <= 1e-6
    # the number of rare words that are looked up changes the work alone
    for rarest in (0, 1, 10**6):
        assert lic.describe(words, lic.Index({b"the": 100, b"license": 90, b"cc": 40}, 100, rarest)) == told


def test_labels_and_scores_of_notices():
    index = lic.Index({b"the": 100, b"license": 90}, 100)
    told = lambda text: lic.describe(lic.words_of(text), index)[5:]
    assert told("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")[0] == "mit"
    assert told("Licensed under the Apache License, Version 2.0")[0] == "apache"
    assert told("under the GNU Lesser General Public License")[0] == "gpl,lgpl"
    assert told("This work is CC BY-SA 4.0")[0] == "cc-by,cc-by-sa"
    assert told("permission granted, charge hereby free") == ("", 0.0)
    whole = " ".join(w.decode() for w in next(t.words for t in lic.TEMPLATES if t.label == "mit"))
    half = " ".join(whole.split()[:20])
    assert 0 < told("cc by")[1] < 0.5 < told(whole)[1] and told(half)[1] < told(whole.replace("merge", "merge and")) [1] <= 1


def test_documents(spark):
    texts = [None, "", "all rights reserved. All Rights Reserved", "cc-by", "word " * 60000 + "general public license", "cc-by"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "mit license", None, None), (5, "cc-by", None, None)]
    found = lic.scan_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)
    assert lic.scan_documents(spark.createDataFrame([], DOCS)).count() == 0
