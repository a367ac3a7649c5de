"""SimHash fingerprints and near-duplicate components by multi-index hashing.

A fingerprint takes the majority of each bit over the XXH64 values (seed 42) of
a document's word shingles. Two fingerprints that differ in at most three bits
agree up to one bit in at least one of their two 32-bit halves, so every
half is a table key, and a probe enumerates the Hamming ball of radius 1 around
its own half. Every fetched match is verified over all 64 bits.

Only distinct fingerprints are probed: copies of a text share one and are
linked without any pair. Of two keys that differ in one bit, the one that has 0
there reaches the other by setting it; so a probe sets bits and never clears any,
which halves the probes and finds each such pair once.

Few edits move a fingerprint of shingles by more than three bits. So `one_of_each` also links
texts of a five-word similarity of 0.8 or more, found by an exact prefix-filtered join of their shingles,
whatever their fingerprints are. In one order of all shingles, two such texts share one of the first fifth of theirs; the order
decides only how many candidates there are, so common shingles are put last as a sample of texts shows them.
Under each shingle, the text with the fewest shingles of its own is compared with the others first, and texts near each other in size; then all pairs
whose groups still differ, of which a large group of copies has few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected
from .shared import forget, release, remove, staged, staged_at

#: Shingles hashed at once, so that a very long text needs little memory.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 3, distinct: bool = False) -> int:
    """The 64-bit fingerprint of a text, 0 for none: as an unsigned number. distinct: a repeated shingle counts once.

    >>> fingerprint(None), fingerprint(" \\t"), fingerprint("A b") == fingerprint("a\\nB")
    (0, 0, True)
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if distinct:
        words = sorted({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
        size = 1
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + size - 1]
        k = min(n - at, CHUNK)
        shingles = zip(*(part[i:] for i in range(size))) if n > 1 or len(words) == size else [part]
        hashes = np.fromiter((digest(b" ".join(s), 42) for s in shingles), np.uint64, k)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, size: int = 3, distinct: bool = False) -> Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size, distinct) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def links(prints: DataFrame, hot: int = 1024) -> DataFrame:
    """All pairs of distinct fingerprints at distance 1 to 3, as (a, b), some of them twice.

    prints: a column fp without repeats. A half that more than `hot`
    fingerprints share is looked up by a finer key: the half and any byte of the
    other half, since at most three of its four bytes can differ.
    """
    sides = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn("key", F.expr("shiftrightunsigned(fp, 32 * half) & 4294967295"))
    spark = prints.sparkSession
    # counted by partial sums; few keys are hot, and their size is known once they are written
    hot_keys, path = staged_at(sides.groupBy("half", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("half", "key"), "simhash-hot")
    crowded = not hot_keys.isEmpty()
    balls = sides.select(
        F.col("fp").alias("other"),
        "half",
        F.explode(
            F.concat(
                F.array(F.col("key")),
                F.expr("transform(filter(sequence(0, 31), i -> shiftright(key, i) & 1 = 0), i -> key | shiftleft(1L, i))"),
            )
        ).alias("key"),
    )
    # Spark takes a generated side for as small as the table it comes from, and would send all of it through the driver
    balls = balls.hint("merge")
    near = "bit_count(fp ^ other) <= 3 AND (fp < other OR (shiftrightunsigned(fp, 32 * half) & 4294967295) <> (shiftrightunsigned(other, 32 * half) & 4294967295))"
    as_pair = (F.col("fp").alias("a"), F.col("other").alias("b"))
    if not crowded:
        remove(spark, path)
        return sides.join(balls, ["half", "key"]).where(near).select(*as_pair)
    pairs = sides.join(hot_keys, ["half", "key"], "left_anti").join(balls, ["half", "key"]).where(near).select(*as_pair)
    thick = sides.join(hot_keys, ["half", "key"], "left_semi")
    fine = "explode(array(0, 1, 2, 3)) AS byte"
    value = "shiftrightunsigned({0}, 32 * (1 - half) + 8 * byte) & 255 AS value"
    left = thick.selectExpr("fp", "half", "key", fine).selectExpr("*", value.format("fp"))
    probes = balls.join(hot_keys, ["half", "key"], "left_semi")
    right = probes.selectExpr("other", "half", "key", fine).selectExpr("*", value.format("other"))
    return pairs.unionByName(left.join(right.hint("merge"), ["half", "key", "byte", "value"]).where(near).select(*as_pair).distinct())


def _named(docs: DataFrame, id_column: str, text_column: str, size: int, hot: int) -> DataFrame:
    """(doc_id, print, fp, root, component_id); root is a component's least fingerprint, print tells the texts of rows without an id apart."""
    text = F.col(text_column).cast("string")
    marked = staged(docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"), fingerprint_column(text, size).alias("fp")), "simhash")
    prints = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    groups = connected(links(prints.select("fp"), hot))
    joined = prints.join(groups, prints.fp == groups.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(joined.join(roots, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, hot: int = 1024) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row of docs.

    component_id is the smallest id that is reachable over links, the row's own
    included. Texts that are null, empty or blank have fingerprint zero and link like any
    other. Rows with a null id keep their fingerprint and get the least id of
    their component, null if it has none; repeated rows and ties come out as often as they
    went in; texts of any length are hashed whole; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    return _named(docs, id_column, text_column, size, hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """In order, a 64-bit number (signed) for each distinct shingle of a text's lower-cased words, made of the words' XXH64; for all its words if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(max(1, len(words) - size + 1), np.uint64)
    for i in range(min(size, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
    return np.sort(np.unique(out ^ out >> np.uint64(32)).view(np.int64))


def _shingled(texts: DataFrame, size: int = 5) -> tuple[DataFrame, str]:
    """(node, s), written: the shingle sets of texts (node, text); and where they are."""

    @F.pandas_udf("array<long>")
    def shingles(part: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, size) for t in part])

    return staged_at(texts.select("node", shingles("text").alias("s")), "shingle-sets")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return met.where(f"i >= {least} * (size(sa) + size(sb) - i)").select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have a Jaccard similarity of shingles of at least `least`; two texts without words are alike."""
    distinct = staged(pairs.distinct(), "near-pairs")
    asked = distinct.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return _alike(distinct, _shingled(texts.join(asked, "node"), size)[0], least)


#: Least similarity of texts that are linked; shingles put last in the order at most; one text in so many is read for them; words of 64 bits that tell which shingles a text shares.
LEAST, COMMON, SAMPLE, MARKS = 0.8, 1 << 16, 8, 4


def _common(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample of texts (node, text), the rarer first. They change the order, not the pairs that are found."""

    @F.pandas_udf("array<long>")
    def shingles(part: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t) for t in part])

    few = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).dropDuplicates(["node"])
    counts = staged(few.select(F.explode(shingles("text")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "common")
    steps = sorted(counts.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("k")).collect(), reverse=True)
    held, cut = 0, 1001
    for n, k in steps:
        if held + k > COMMON:
            break
        held, cut = held + k, n
    return np.array([s for _, s in sorted((r.n, r.s) for r in counts.where(F.col("n") >= cut).collect())], np.int64)


class Ranks:
    """The order of shingles: by number, and then the common ones, the rarer first."""

    def __init__(self, common: np.ndarray) -> None:
        order = np.argsort(common)
        self.common, self.rank = common[order], order

    def prefix(self, shingles: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, float]:
        """The first of a text's shingles, of which a text as similar has one among its own first: those that are not common, and the common ones; and the share of the former in all.

        >>> [x.tolist() for x in Ranks(np.array([1])).prefix(np.array([1, 2, 3, 4, 5]))[:2]], Ranks(np.array([2, 1])).prefix(np.array([1, 2]), 0.5)[1].tolist()
        ([[2, 3], []], [2, 1])
        """
        n = len(shingles)
        if not n:
            return shingles, shingles, 1.0
        k = n - math.ceil(least * n - 1e-9) + 1
        at = np.minimum(np.searchsorted(self.common, shingles), max(0, len(self.common) - 1))
        ranked = self.common[at] == shingles if len(self.common) else np.zeros(n, bool)
        rare, often = shingles[~ranked], shingles[ranked]
        first = rare[:k].copy()  # not a view, which would hold the whole set
        return first, often[np.argsort(self.rank[at[ranked]])][: k - len(first)], len(rare) / n


def shared_prefixes(texts: DataFrame) -> DataFrame:
    """(s, node, n, hub, hub_n, q, marks, before): the prefix shingles that two nodes of texts (node, text) share, each node's number of shingles, and of those of its prefix that it shares their number q, a bit for each, and the one before by number.

    hub is the shingle's node with the least share of shingles that are not common: of a text and its edited copies, that is the text, since every edit
    makes shingles of its own. Ranked shingles, which very many texts may have, are aggregated in part before they are shuffled, and joined back;
    the others, nearly all of which are one text's alone, are shuffled once.
    """
    common = _common(texts)

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = Ranks(common)
        for part in parts:
            rows = [(len(s := shingle_set(t)), *ranks.prefix(s)) for t in part["text"]]
            yield pd.DataFrame({"node": part["node"]}).assign(**dict(zip(("n", "rare", "ranked", "own"), map(list, zip(*rows, strict=True)), strict=True)))[["node", "n", "own", "rare", "ranked"]]
        release()

    arrays = texts.select("node", "text").mapInPandas(first, "node long, n int, own double, rare array<long>, ranked array<long>")
    single = arrays.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "own", "rare", "ranked")])
    # one row a shingle for both kinds, so that the shuffle of the arrays is done once
    both = "explode(concat(transform(rare, x -> (x AS s, false AS often)), transform(ranked, x -> (x AS s, true AS often)))) AS p"
    rows = single.selectExpr("node", "n", "own", both).select("p.*", "node", "n", "own")
    ahead = Window.partitionBy("s").orderBy("own", "node")
    rare = rows.where("NOT often")
    rare = rare.select("s", "node", "n", F.first("node").over(ahead).alias("hub"), F.first("n").over(ahead).alias("hub_n"), F.lead("node").over(ahead).alias("next")).where("node <> hub OR next IS NOT NULL").drop("next")
    often = rows.where("often").drop("often")
    met = often.groupBy("s").agg(F.count("*").alias("k"), F.min(F.struct("own", "node", "n")).alias("hub")).where("k > 1")
    often = often.join(met, "s").select("s", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared, path = staged_at(rare.unionByName(often), "shared")
    # a node's rows are a part of its text's prefix
    mine = Window.partitionBy("node")
    bit = f"pmod(xxhash64(s), {64 * MARKS})"
    marks = F.array(*[F.bit_or(F.expr(f"if({bit} DIV 64 = {i}, shiftleft(1L, CAST({bit} % 64 AS int)), 0L)")).over(mine) for i in range(MARKS)])
    known = staged(shared.select("*", F.count("*").over(mine).alias("q"), marks.alias("marks"), F.lag("s").over(mine.orderBy("s")).alias("before")), "shared-prefixes")
    remove(texts.sparkSession, path)
    return known


def _enough(c: str, least: float = LEAST) -> str:
    """Whether two texts of na and nb shingles that share c in their prefixes can be similar: what else they share lies beyond where the first prefix of both ends."""
    return f"{c} + greatest(ceil({least}D * na - 1e-9D), ceil({least}D * nb - 1e-9D)) - 1 >= {least / (1 + least)}D * (na + nb) - 1e-6D"


def _possible(met: DataFrame) -> DataFrame:
    """Of met (a, na, b, nb), a row for each shared prefix shingle, the pairs (a, b) that can be similar."""
    return met.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")).where(_enough("c")).select("a", "b")


def _near_size(least: float = LEAST) -> str:
    return f"least(na, nb) >= {least}D * greatest(na, nb) - 1e-6D"


#: Parts into which the texts of a shingle are dealt, and the next ones by size there that each is compared with first.
DEALT, NEXT = 64, 4


def neighbours(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of a shingle's hub and its other nodes, and of nodes near each other by size, 1 + NEXT times as many as rows of shared_prefixes() at most."""
    hubs = shared.where("node <> hub").selectExpr("hub AS a", "hub_n AS na", "node AS b", "n AS nb", "q AS c")
    by_size = Window.partitionBy("s", "part").orderBy("n", "node")
    dealt = shared.select("s", "node", "n", "q", F.expr(f"pmod(xxhash64(node), {DEALT})").alias("part"))
    before = [F.struct(*[F.lag(c, i).over(by_size).alias(c) for c in ("node", "n", "q")]) for i in range(1, NEXT + 1)]
    beside = dealt.select("node", "n", "q", F.array(*before).alias("others")).select("node", "n", "q", F.explode("others").alias("p")).where("p.node IS NOT NULL")
    beside = beside.selectExpr("p.node AS a", "p.n AS na", "node AS b", "n AS nb", "least(q, p.q) AS c")
    swap = "a < b"
    # two nodes share no more of their prefixes than either shares with any
    pairs = hubs.unionByName(beside).where(f"{_near_size()} AND {_enough('c')}")
    # a pair may be told for fewer shingles than it shares; one that falls out for that is met by across()
    return _possible(pairs.selectExpr("least(a, b) AS a", f"if({swap}, na, nb) AS na", "greatest(a, b) AS b", f"if({swap}, nb, na) AS nb"))


def _shared_most() -> str:
    """How many of their prefix shingles two nodes can share: each one's, without those whose bit the other does not have."""
    lacks = lambda x, y: " + ".join(f"bit_count(m{x}[{i}] & ~m{y}[{i}])" for i in range(MARKS))
    return f"least(qa - ({lacks('a', 'b')}), qb - ({lacks('b', 'a')}))"


def mixed(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(s, node, n, q, marks, before, whole, big): the rows of shingles that more than one of the groups (node, whole) share, with the shingle's largest group."""
    rows = staged(shared.select("s", "node", "n", "q", "marks", "before").join(groups, "node"), "prefix-groups")
    sizes = rows.groupBy("s", "whole").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("whole", F.struct("k", "whole")).alias("big"), F.count("*").alias("groups"))
    return rows.join(sizes.where("groups > 1").select("s", "big"), "s")


def across(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes in different groups of mixed() that can be similar; under a shingle, its largest group is not met with itself.

    A pair shares no more prefix shingles than either shares with any node, and none whose bit only one of them has: by that, most pairs fall out where they meet. Copies share long runs
    of shingles. Where the shingle before is the same for both, they have met under that one already; so a pair meets once for each run and not for each shingle.
    """
    side = lambda x: ("s", f"node AS {x}", f"n AS n{x}", f"q AS q{x}", f"marks AS m{x}", f"whole AS w{x}", f"before AS before_{x}")
    left, right = rows.where("whole <> big").selectExpr(*side("a")), rows.selectExpr(*side("b"), "big")
    met = left.join(right, "s").where(f"wa <> wb AND (wb = big OR a < b) AND NOT coalesce(before_a = before_b, false) AND {_near_size()} AND {_enough(_shared_most())}")
    return met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, hot: int = 1024) -> DataFrame:
    """The rows of docs that stay when one document of each group of near copies does: that with the smallest id.

    Groups are those of near_duplicates(), joined where any two of their texts have a five-word
    similarity of LEAST or more. Repeated rows of a document that stays are one; where they differ in other columns,
    that of the least hash. Where all ids of a group are null, its first text by hash stays. Null and blank texts are one group;
    texts of any length are compared whole; other columns stay, whatever their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    named = staged(_named(docs, id_column, text_column, size, hot), "near-groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "print")).alias("f")
    first = staged(named.groupBy("root").agg(best).selectExpr("root", "f.doc_id AS doc_id", "f.print AS print"), "near-first")
    keys = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    nodes = staged(named.groupBy("root", "print").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.col("print")), "near-nodes")
    forget(spark)  # here and below: the plans of a part that is done are many, and the next ones would come on top of them in the driver
    shared = shared_prefixes(keys.select(F.col("print").alias("node"), "text"))
    forget(spark)

    def confirmed(pairs: DataFrame) -> DataFrame:
        # no pair comes twice from neighbours() or across()
        pairs, pairs_path = staged_at(pairs, "near-candidates")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        chosen = nodes.join(asked, "node").select("node", F.col("doc_id").alias("_id"))
        # one row of each text, by both columns, so that the copies of a text do not meet in one task
        texts = keys.join(chosen, F.expr("doc_id <=> _id AND print = node")).select("node", "text").dropDuplicates(["node"])
        sets, sets_path = _shingled(texts)
        found = _alike(pairs, sets, LEAST)
        roots = [nodes.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
        links = staged(found.join(roots[0], "a").join(roots[1], "b").where("root_a <> root_b").select("root_a", "root_b").distinct(), "near-links")
        remove(spark, pairs_path, sets_path)
        forget(spark)
        return links

    def wholes(links: DataFrame) -> DataFrame:
        groups = connected(links).withColumnRenamed("component", "whole")
        return staged(first.join(groups, first.root == groups.node, "left").select("root", "doc_id", "print", F.coalesce("whole", "root").alias("whole")), "near-wholes")

    some = confirmed(neighbours(shared))
    rest = confirmed(across(mixed(shared, nodes.join(wholes(some).select("root", "whole"), "root").select("node", "whole"))))
    joined = wholes(some.unionByName(rest))
    stay = staged(joined.groupBy("whole").agg(best).select("f.doc_id", F.col("f.print").alias("print")), "near-stay")
    # all columns of a row in one struct, so that none can clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("print"))
    kept = rows.join(stay.withColumnRenamed("print", "stays"), F.expr("id <=> doc_id AND print = stays"), "left_semi")
    return kept.groupBy("id", "print").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
