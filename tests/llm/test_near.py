import random
import re

import numpy as np
import pytest
import xxhash

from kappaloom.llm import simhash

DOCS = "doc_id long, text string, fingerprint string, component string"


def brute(rows, distance=3):
    prints = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return [(doc_id, f"{prints[i]:016x}", least.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "null id alone"), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, "a b c"), (None, "a b c"), (40, "a b c"), (41, "word " * 70000)]
    for k in range(6):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(300)] = rng.choice(words)
            rows.append((100 + len(rows), " ".join(copy)))
    return rows + rows[-3:]


@pytest.mark.parametrize("hot", [1024, 0])
def test_components(spark, hot):
    rows = corpus()
    found = simhash.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS), hot=hot).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("hot", [1024, 2])
def test_links_of_fingerprints(spark, hot):
    rng = random.Random(1)
    prints = {0, 1, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(3):
            near = base
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                near ^= 1 << b
            prints.add(near)
    prints |= {7 << 40 | i for i in range(12)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()}
    expected = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == expected


def test_empty_and_one_of_each(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d", "k", "z"), (2, "a b c d", None, None), (3, "other words stand here", None, None), (3, "other words stand here", None, None), (None, "a b c d", None, None), (None, "only without id", None, None), (None, "only without id", None, None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(1, "a b c d"), (3, "other words stand here"), (None, "only without id")]


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "id", "print", "row", "stays", "_id", "_print", "_stays", "node", "root"]
    rows = [(i, t, *"abcdefghi") for i, t in ((1, "one two three four"), (2, "one two three four"), (3, None), (4, " "))]
    kept = simhash.one_of_each(spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)))
    assert kept.columns == names and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
    assert simhash.one_of_each(kept.limit(0)).columns == names


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(250)]
        rows.append((k, " ".join(base), "x", "y"))
        if k < 20:
            copy = list(base)
            for i in rng.sample(range(250), 2):
                copy[i] = rng.choice(words)
            rows.append((100 + k, " ".join(copy), "x", "y"))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(range(40)) <= kept and len(kept) <= 42


def test_similarity(spark):
    base = [f"w{i}" for i in range(100)]
    edited = lambda n: " ".join("x" if i % 10 == 5 and i < 10 * n else w for i, w in enumerate(base))
    texts = [(0, edited(0)), (1, edited(1)), (2, edited(2)), (3, edited(3)), (4, None), (5, " "), (6, "W0 w1"), (7, "w0  w1")]
    pairs = [(i, j) for j in range(8) for i in range(j)] + [(0, 1)]
    found = {(r.a, r.b) for r in simhash.similar(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "node long, text string")).collect()}

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    expected = {(i, j) for i, j in pairs if len(grams(texts[i][1]) & grams(texts[j][1])) >= 0.8 * len(grams(texts[i][1]) | grams(texts[j][1]))}
    assert found == expected and (0, 1) in found and (0, 3) not in found


def joined_by_similarity(rows):
    """Ids that stay when texts in any order are joined by three bits or by a five-word similarity of 0.8, and by nothing else."""
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    group = {i: i for i, _ in rows}
    for i, _ in rows:
        for j, _ in rows:
            if j < i and ((prints[i] ^ prints[j]).bit_count() <= 3 or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def test_cut_and_lengthened_copies_go(spark):
    rng = random.Random(21)
    words = [f"word{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(40)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(100, 300))]
        base = common + base if k % 3 == 0 else base
        n = len(base)
        rows.append((k, " ".join(base)))
        rows += [(100 + k, " ".join(base[: n - n * (k % 3 + 1) // 20])), (200 + k, " ".join([rng.choice(words) for _ in range(n * (k % 6) // 20)] + base)), (300 + k, " ".join(base[: n * 7 // 10]))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)).collect()}
    assert kept == joined_by_similarity(rows)
    assert {i for i in kept if i < 200} == set(range(60))


def chain_of_three_bits():
    """Texts whose fingerprints are linked in a chain, and a cut copy that only the last of them is similar to."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    chain, prints = [[rng.choice(words) for _ in range(200)]], []
    while len(chain) < 30:
        now = simhash.fingerprint(" ".join(chain[-1]))
        for _ in range(2000):
            edited = list(chain[-1])
            edited[rng.randrange(200)] = rng.choice(words)
            if (simhash.fingerprint(" ".join(edited)) ^ now).bit_count() <= 3:
                chain.append(edited)
                break
        else:
            raise AssertionError("no chain")
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)]
    return [*rows, (50, " ".join(chain[-1][:170]))]


def test_links_of_later_members_join_a_group(spark):
    rows = chain_of_three_bits()
    assert joined_by_similarity(rows) == {0} and joined_by_similarity([rows[0], rows[-1]]) == {0, 50}
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)).collect()}
    assert kept == {0}


@pytest.mark.parametrize(("hot", "merges"), [(1024, 1), (0, 2)])
def test_generated_sides_are_not_broadcast(spark, hot, merges):
    from kappaloom.sources.shared import staged

    prints = staged(spark.range(1000).selectExpr("xxhash64(id) AS fp"), "few-prints")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = simhash.links(prints, hot)._jdf.queryExecution().executedPlan().toString()
        # a broadcast of what explode() makes of the prints would pass the driver
        tops = [i for i, line in enumerate(plan.splitlines()) if "BroadcastExchange" in line]
        lines = plan.splitlines()
        depth = lambda line: len(re.match(r"[\s:+\-]*", line)[0])
        below = [next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(lines[i])), len(lines)) for i in tops]
        assert not any("Generate" in line for i, end in zip(tops, below, strict=True) for line in lines[i:end])
        assert plan.count("SortMergeJoin") >= merges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
