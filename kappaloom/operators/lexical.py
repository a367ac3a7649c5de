"""Lexical features and baselines: TF-IDF by joins, pair features, windows of tokens, cross-validated classifiers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.shared import remove, staged, staged_at
from .order import hash_numbered, indexed

#: What counts as a term: letters and digits, the accented ones of western languages included.
TERM = "[a-z0-9à-öø-ÿ]+"
TERM_PATTERN = re.compile(TERM)


def term_counts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, term, tf) of the lower-cased text's terms."""
    terms = df.select(id_column, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy(id_column, "term").agg(F.count("*").alias("tf"))


def word_grams(text: str, most: int = 2) -> Iterator[str]:
    """The runs of 1 to `most` terms of a lower-cased text, joined by a space, w before them."""
    words = TERM_PATTERN.findall(text)
    for n in range(1, most + 1):
        yield from ("w " + " ".join(run) for run in zip(*(words[i:] for i in range(n)), strict=False))


def bordered_grams(text: str, least: int = 3, most: int = 5) -> Iterator[str]:
    """The runs of `least` to `most` characters inside a lower-cased text's words, of which each has a space on both sides; c before them.

    A word that is no longer than a run, spaces included, gives it once and none that is longer.
    """
    for word, times in Counter(text.split()).items():
        padded = f" {word} "
        for n in range(least, min(most, max(least, len(padded))) + 1):
            for i in range(max(1, len(padded) - n + 1)):
                run = "c" + padded[i : i + n]
                for _ in range(times):
                    yield run


def gram_counts(df: DataFrame, id_column: str, text: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf, also) of a text's word runs and bordered character runs. Counted text by text: arrays of all runs in expressions take thirty times as long.

    also: string columns of df that come along, so that no row of a term has to be joined with its text's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column("t").to_pylist()):
                low = (value or "").lower()
                found = Counter(word_grams(low))
                found.update(bordered_grams(low))
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found))), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64()), *(batch.column(c).take(pa.array([i] * len(found))) for c in also)], [id_column, "term", "tf", *also])

    schema = ", ".join([f"`{id_column}` {dict(df.dtypes)[id_column]}, term string, tf long", *(f"`{c}` string" for c in also)])
    return df.select(id_column, text.cast("string").alias("t"), *also).mapInArrow(count, schema)


def inverse_frequencies(counts: DataFrame, documents: DataFrame, least: int = 2) -> DataFrame:
    """(term, idf): ln((1 + n) / (1 + df)) + 1 of the terms in at least so many of the n documents."""
    n = documents.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame, id_column: str) -> DataFrame:
    """(id, term, w): (1 + ln tf) * idf, of unit length for each id."""
    raw = counts.join(idf, "term").select(id_column, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy(id_column).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, id_column).select(id_column, "term", (F.col("w") / F.col("norm")).alias("w"))


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(pair, term, p, h, difference, product) over the union of both sides' terms; an absent term weighs 0."""
    p = pairs.join(left, left_id).select(left_id, right_id, "term", F.col("w").alias("p"), F.lit(0.0).alias("h"))
    h = pairs.join(right, right_id).select(left_id, right_id, "term", F.lit(0.0).alias("p"), F.col("w").alias("h"))
    both = p.unionByName(h).groupBy(left_id, right_id, "term").agg(F.sum("p").alias("p"), F.sum("h").alias("h"))
    return both.select("*", F.abs(F.col("p") - F.col("h")).alias("difference"), (F.col("p") * F.col("h")).alias("product"))


def token_windows(df: DataFrame, id_column: str, words: Column, size: int, stride: int) -> DataFrame:
    """(id, window, first, last, words): windows of so many tokens every stride, the last one reaching the end; one for a short text."""
    rows = df.select(id_column, words.alias("_w"))
    count = F.greatest(F.lit(1), F.ceil((F.size("_w") - size) / F.lit(float(stride))) + 1).cast("int")
    starts = rows.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * stride)).alias("window", "at"))
    last = F.least(F.col("at") + size, F.size("_w"))
    return starts.select(id_column, "window", (F.col("at") + 1).alias("first"), last.alias("last"), F.slice("_w", F.col("at") + 1, last - F.col("at")).alias("words"))


def supervised_windows(windows: DataFrame, gold: DataFrame, id_column: str) -> DataFrame:
    """windows with start and end: where the gold span stands in a window that holds all of it, from 1 inside the window; null in other windows.

    gold (id, gold_first, gold_last): token numbers from 1 in the whole text, null for a neutral. Adds positive, the number of the text's windows with the
    span: a span with none is longer than a window, or fell between two, which a caller may refuse.
    """
    met = windows.join(gold, id_column, "left")
    inside = (F.col("gold_first") >= F.col("first")) & (F.col("gold_last") <= F.col("last"))
    place = lambda c: F.when(inside, F.col(c) - F.col("first") + 1)
    marked = met.withColumns({"start": place("gold_first"), "end": place("gold_last")})
    positive = marked.groupBy(id_column).agg(F.count("start").alias("positive"))
    return marked.join(positive, id_column).drop("gold_first", "gold_last")


def window_batches(sizes: DataFrame, id_column: str, windows: str, most_items: int, budget: int, block: int = 100_000) -> DataFrame:
    """(id, batch): items in id order fill a batch until the next would exceed its number of items or of windows; one of more windows than the budget fills one alone.

    Filling is sequential, but a batch holds most_items items at most: so the first batch that begins in a block of
    items begins at one of its first most_items places. For each of these, every block tells, in parallel, where its last batch ends in the next
    block and how many batches it has; these few numbers are followed from block to block, and every block is filled from its own first place.
    """
    numbered = indexed(sizes.select(id_column, F.col(windows).alias("n")), [id_column], "at")
    placed = staged(numbered.withColumn("block", F.expr(f"at DIV {block}")), "window-sizes")
    # a block sees the next one's first places too, where its last batch may end
    seen = placed.unionByName(placed.where((F.col("at") % block < most_items) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1))

    def ends(counts: list[int], begin: int) -> int:
        """Where a batch that begins at a place ends."""
        used, at = 0, begin
        while at < len(counts) and at - begin < most_items and (at == begin or used + counts[at] <= budget):
            used += counts[at]
            at += 1
        return at

    def own(part: pd.DataFrame) -> tuple[list[int], int]:
        part = part.sort_values("at")
        return part["n"].tolist(), int((part["at"] < (part["block"].iloc[0] + 1) * block).sum())

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        counts, size = own(part)
        to = {i: ends(counts, i) for i in range(size)}
        # from the last place back: where the batches from each place leave the block, and how many they are
        leaves: dict[int, tuple[int, int]] = {}
        for i in range(size - 1, -1, -1):
            at, k = leaves[to[i]] if to[i] < size else (to[i] - size, 0)
            leaves[i] = (at, k + 1)
        rows = [(int(part["block"].iloc[0]), i, *(leaves[i] if i < size else (i - size, 0))) for i in range(most_items)]
        return pd.DataFrame(rows, columns=["block", "enter", "leave", "batches"])

    hops = seen.groupBy("block").applyInPandas(follow, "block long, enter long, leave long, batches long")

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        table = {(b, e): (leave, k) for b, e, leave, k in part.itertuples(index=False)}
        enter, before, rows = 0, 0, []
        for b in sorted(part["block"].unique().tolist()):
            rows.append((b, enter, before))
            enter, k = table[b, enter]
            before += k
        return pd.DataFrame(rows, columns=["block", "enter", "before"])

    entered = hops.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda p: chain(p.drop(columns="_all")), "block long, enter long, before long")  # most_items rows a block

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        counts, size = own(part)
        enter, before = int(part["enter"].iloc[0]), int(part["before"].iloc[0])
        batch = [before - 1] * size  # what stands before the first place belongs to the batch that came in
        at, k = enter, before
        while at < size:
            stop = ends(counts, at)
            batch[at : min(stop, size)] = [k] * (min(stop, size) - at)
            at, k = stop, k + 1
        done = part.sort_values("at").head(size)[[id_column]].copy()
        done["batch"] = batch
        return done

    kind = dict(sizes.dtypes)[id_column]
    return seen.join(entered, "block").groupBy("block").applyInPandas(fill, f"{id_column} {kind}, batch long")


def vocabulary(df: DataFrame, id_column: str, text: Column, least: int = 2) -> DataFrame:
    """(term, idf, at): the runs of words and characters that `least` texts have, with their places in vectors.

    Terms are numbered by a join, so that none is hashed into another's place or dropped.
    """
    counts, path = staged_at(gram_counts(df, id_column, text).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least), "gram-texts")
    n = df.agg(F.count("*").alias("n"))
    idf = counts.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    terms = staged(hash_numbered(idf.withColumn("_one", F.lit(0)), ["_one"], F.sha2("term", 256), "term", "at").select("term", "idf", "at"), "terms")
    remove(df.sparkSession, path)
    return terms


def as_vectors(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, x) of rows (keys, v), v an array of (at, w) in the order of at: sparse vectors, written as what they consist of and read as vectors."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("v.at").alias("indices"), F.col("v.w").alias("values"))
    flat = rows.select(*keys, parts.alias("x"))
    path = staged_at(flat, "vectors")[1]
    kinds = {f.name: f for f in flat.schema}
    return rows.sparkSession.read.schema(StructType([*[kinds[k] for k in keys], StructField("x", VectorUDT())])).parquet(path)


_PLACED = "array<struct<at:int,w:double>>"


def vectors(df: DataFrame, id_column: str, text: Column, places: DataFrame) -> DataFrame:
    """(id, x): the unit vectors of (1 + ln tf) * idf over a vocabulary(), of these texts or of others; a text without its terms has an empty one."""
    # terms meet their weight and place in one join, and norms come with the texts' arrays, so that a term is shuffled twice and not six times
    raw = gram_counts(df, id_column, text).join(places.select("term", "idf", F.col("at").cast("int").alias("at")), "term").select(id_column, "at", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    rows = raw.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = F.transform("v", lambda p: F.struct(p["at"].alias("at"), (p["w"] / F.col("norm")).alias("w")))
    whole = df.select(id_column).join(rows.select(id_column, unit.alias("v")), id_column, "left").select(id_column, F.coalesce("v", F.array().cast(_PLACED)).alias("v"))
    return as_vectors(whole, [id_column], max(1, places.count()))


def predicted(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """rows (id, x, ...) with the probability of class 1 in place of x."""
    return model.transform(rows).withColumn("probability", F.element_at(vector_to_array("probability"), 2)).drop("x", "rawPrediction", "prediction")


def _fitted(rows: DataFrame, label: str, penalty: float, balanced: bool, share: float | None = None) -> LogisticRegressionModel:
    """A logistic model; balanced: classes weigh the same in sum. share: that of class 1, if it is known."""
    if share is None and balanced:
        share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = 0.5 if share is None or not balanced else min(max(share, 1e-9), 1 - 1e-9)
    weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    return LogisticRegression(featuresCol="x", labelCol=label, weightCol="_weight", regParam=penalty, maxIter=12, tol=1e-4).fit(rows.withColumn("_weight", weight))


@dataclass(frozen=True)
class Limits:
    """Which terms of the training texts are features: those in at least `least` texts and in a share of them at most; of words and of characters the `most` frequent ones each, ties by term."""

    least: int = 2
    share: float = 1.0
    most: int | None = None


def plan_cells(plan: DataFrame, id_column: str, cell: str) -> DataFrame:
    """(id, cell): texts that have the same rows in plan (id, held, inner_fold) have one cell."""
    row = F.format_string("%d:%d", F.col("held").cast("long"), F.col("inner_fold").cast("long"))
    return plan.groupBy(id_column).agg(F.array_join(F.array_sort(F.collect_list(row)), ",").alias(cell))


def training_terms(counts: DataFrame, plan: DataFrame, id_column: str, limits: Limits = Limits(), cell: str | None = None) -> DataFrame:
    """(held, without, term, idf): the terms of every training set, with frequencies of its texts alone.

    counts (id, term, tf); plan (id, held, inner_fold) has a row for each text and each outer fold that it is not in. A training set is
    what is not held, without an inner fold or, where without is -1, all of it. Frequencies are counted once for each term and cell of the plan; a set's
    are the sums of its held fold less those of the cell that is left out.

    cell: a column of counts that plan_cells() made of the plan. Terms are then added up by it, and only the sums meet the plan, not every text's terms.
    """
    if cell is None:
        found = counts.join(plan, id_column).groupBy("held", "inner_fold", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    else:
        # a few rows for each pair of folds
        rows = F.transform(F.split(cell, ","), lambda x: F.struct(F.split(x, ":")[0].cast("long").alias("held"), F.split(x, ":")[1].cast("long").alias("inner_fold")))
        sums = counts.where(F.col(cell).isNotNull()).groupBy(cell, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
        found = sums.select("term", "df", "tf", F.explode(rows).alias("_p")).groupBy("_p.held", "_p.inner_fold", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    cells = staged(found, "term-cells")
    sizes = staged(plan.groupBy("held", "inner_fold").agg(F.count("*").alias("n")), "fold-sizes")  # a row for each pair of folds
    whole = cells.groupBy("held", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    texts = sizes.groupBy("held").agg(F.sum("n").alias("n"))
    without = sizes.select("held", F.col("inner_fold").alias("without"), F.col("n").alias("n_own")).unionByName(texts.select("held", F.lit(-1).cast("long").alias("without"), F.lit(0).cast("long").alias("n_own")))
    sets = without.join(texts, "held").select("held", "without", (F.col("n") - F.col("n_own")).alias("n"))
    own = cells.select("held", F.col("inner_fold").alias("without"), "term", F.col("df").alias("df_own"), F.col("tf").alias("tf_own"))
    left = whole.join(sets, "held").join(own, ["held", "without", "term"], "left").na.fill(0, ["df_own", "tf_own"])
    left = left.select("held", "without", "n", "term", (F.col("df") - F.col("df_own")).alias("df"), (F.col("tf") - F.col("tf_own")).alias("tf"))
    kept = left.where((F.col("df") >= limits.least) & (F.col("df") <= F.col("n") * limits.share))
    if limits.most is not None:
        order = Window.partitionBy("held", "without", F.substring("term", 1, 1)).orderBy(F.desc("tf"), "term")
        kept = kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limits.most)
    return kept.select("held", "without", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def training_vectors(counts: DataFrame, terms: DataFrame, texts: DataFrame, id_column: str, bounded: bool = False) -> DataFrame:
    """(held, without, id, x): every text's unit vector of (1 + ln tf) * idf by the terms of each training set.

    Places are numbers of all terms that any set has. A set's vectors have weights at its own terms alone, so a place says nothing of a text that the set does not know. bounded: the terms are so
    few, by Limits.most, that they can go to all tasks; else they and all terms of all texts are shuffled.
    """
    distinct = terms.select("term", F.lit(0).alias("_one")).distinct()
    places = staged(hash_numbered(distinct, ["_one"], F.sha2("term", 256), "term", "at").select("term", F.col("at").cast("int").alias("at")), "places")
    keys = ["held", "without", id_column]
    placed = terms.join(places, "term")
    raw = counts.join(F.broadcast(placed) if bounded else placed, "term").select(*keys, "at", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    rows = raw.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = F.transform("v", lambda p: F.struct(p["at"].alias("at"), (p["w"] / F.col("norm")).alias("w")))
    sets = F.broadcast(staged(terms.select("held", "without").distinct(), "training-sets"))  # a row for each pair of folds
    whole = texts.select(id_column).join(sets).join(rows.select(*keys, unit.alias("v")), keys, "left").select(*keys, F.coalesce("v", F.array().cast(_PLACED)).alias("v"))
    return as_vectors(whole, keys, max(1, places.count()))


def _balanced_accuracy(told: DataFrame, label: str) -> float:
    recalls = [r.r for r in told.groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("r")).collect()]
    return sum(recalls) / len(recalls) if recalls else 0.0


def out_of_fold(rows: DataFrame, nested: DataFrame, label: str, id_column: str, text: Column, grid: tuple[tuple[float, bool], ...] = ((0.01, False), (0.01, True), (0.1, True)), limits: Limits = Limits(), counts: DataFrame | None = None, cell: str | None = None) -> DataFrame:
    """(id, label, fold, probability): that of class 1 for each of rows (id, label, and what text needs), by a model and features that have not seen the row's fold.

    nested (id, fold, held, inner_fold): for every outer fold that is held out, the inner fold of each other row. grid: penalties, and whether classes
    are balanced; for each held fold the choice is that of the best mean balanced accuracy over its inner folds, where features are fitted without the inner fold too. The loop is over folds and
    the grid, not rows. counts: gram_counts() of the texts, if they are known; cell: their column of plan_cells(), if they have it.
    """
    counts = staged(gram_counts(rows, id_column, text), "grams") if counts is None else counts
    plan = staged(nested.select(id_column, F.col("held").cast("long").alias("held"), F.col("inner_fold").cast("long").alias("inner_fold")), "fold-plan")
    folds = staged(nested.select(id_column, F.col("fold").cast("long").alias("fold")).distinct(), "folds")
    terms = training_terms(counts, plan, id_column, limits, cell)
    # without a choice there is nothing to try on inner folds
    terms = staged(terms if len(grid) > 1 else terms.where("without = -1"), "training-terms")
    marked = training_vectors(counts, terms, rows, id_column, limits.most is not None).join(rows.select(id_column, label), id_column).join(folds, id_column)
    # a join with the plan leaves no inner fold in the rows that are held
    known = staged(marked.join(plan, [id_column, "held"], "left"), "training-vectors")
    # a row for each pair of folds: texts, and those of class 1
    sizes = known.where("without = -1").groupBy("held", "inner_fold").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("ones")).collect()

    def share(k: int, without: int = -1) -> float | None:
        cells = [r for r in sizes if r.held == k and r.inner_fold is not None and r.inner_fold != without]
        return sum(r.ones for r in cells) / sum(r.n for r in cells) if cells else None

    out = None
    for k in sorted({r.held for r in sizes}):
        mine = known.where(F.col("held") == k)
        inner = sorted({r.inner_fold for r in sizes if r.held == k and r.inner_fold is not None})

        def score(choice: tuple[float, bool], k: int = k, mine: DataFrame = mine, inner: list[int] = inner) -> float:
            found = []
            for i in inner:
                one = mine.where((F.col("without") == i) & F.col("inner_fold").isNotNull())
                # both classes must be there
                if 0 < (share(k, i) or 0) < 1:
                    model = _fitted(one.where(F.col("inner_fold") != i), label, *choice, share(k, i))
                    found.append(_balanced_accuracy(model.transform(one.where(F.col("inner_fold") == i)), label))
            return sum(found) / len(found) if found else 0.0

        best = max(grid, key=score) if len(grid) > 1 and len(inner) > 1 else grid[0]
        whole = mine.where(F.col("without") == -1)
        scored = predicted(_fitted(whole.where(F.col("inner_fold").isNotNull()), label, *best, share(k)), whole.where(F.col("fold") == k).select(id_column, label, "fold", "x"))
        out = scored if out is None else out.unionByName(scored)
    return out


def refitted(rows: DataFrame, places: DataFrame, label: str, n: int, penalty: float = 0.1, balanced: bool = True) -> tuple[LogisticRegressionModel, DataFrame]:
    """The model of all rows (x, label), to predict others by, and (class, rank, term, coefficient): the n terms that speak most for each class."""
    model = _fitted(rows, label, penalty, balanced)
    coefficients = pd.Series(model.coefficients.toArray(), name="coefficient")
    named = rows.sparkSession.createDataFrame(pa.Table.from_pandas(coefficients[coefficients != 0].rename_axis("at").reset_index(), preserve_index=False)).join(places.select("term", "at"), "at")
    out = None
    for name, sign in ((1, 1), (0, -1)):
        # a term can speak for a class only with a coefficient of its sign
        best = named.where(F.col("coefficient") * sign > 0).orderBy(F.desc(F.col("coefficient") * sign), "term").limit(n)
        best = best.select(F.lit(name).alias("class"), F.row_number().over(Window.orderBy(F.desc(F.col("coefficient") * sign), "term")).cast("long").alias("rank"), "term", "coefficient")
        out = best if out is None else out.unionByName(best)
    return model, out
