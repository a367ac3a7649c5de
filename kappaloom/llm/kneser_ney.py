"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The symbols are characters (UTF-16 code units, so that four of them make one 64-bit key), with any
number of white space characters as one space. A word that repeats the one before it is a
single symbol: a text that repeats itself has a perplexity far too low, as one of foreign writing, of capitals or of marks has
one too high. So a language has two thresholds, a low and a high quantile of trusted texts.

The model is trained on the trusted texts, each once, but for a part that is held out by a hash of the text. The high quantile is
that of the held-out ones, which the model has not seen; the low one that of all, as texts that it has seen have a lower perplexity. Its tables, one for each order, hold every n-gram of the
training texts and grow with them; they are sharded by n-gram and joined.

Texts are never shuffled. They are written once, in blocks of rows; a block asks for each of its n-grams once, the distinct ones are
answered by joins with the count tables, and a block's answers are written to a folder of its own, where the
task that scores the block's texts reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, fresh_path, opened, release, remove, staged, staged_at

#: Symbols of an n-gram: as many as a key has room for.
ORDER = 4
#: What stands for a repeated word, and before a text.
REPEAT, BEGIN = "\x01", "\x02"
#: The symbols there can be: the model's last resort is that all are alike.
SYMBOLS = 1 << 16
#: Rows of a block, symbols handled at once, and n-grams that a task holds before it passes them on.
BLOCK_ROWS, CHUNK, HELD = 1 << 14, 1 << 20, 1 << 22
#: One trusted text in so many is held out; the share of texts beyond each threshold.
HOLD_OUT, BEYOND = 4, 0.001
#: Texts of all languages that are added, as a weight, to each language's own; symbols of median surprisal that are added to each text.
POOLED, PRIOR = 20, 500


def normal(text: str | None) -> tuple[str, int]:
    """A text as the model reads it, and its length before repeated words were made one symbol.

    >>> normal("no  no\\nno, yes"), normal(None)
    (('no \\x01 no, yes', 13), ('', 0))
    """
    words = (text or "").split()
    length = sum(map(len, words)) + max(0, len(words) - 1)
    return " ".join([REPEAT if a == b else a for a, b in zip(words, ["", *words], strict=False)]), length


def pieces(text: str, chunk: int = CHUNK) -> Iterator[bytes]:
    """A text's symbols in parts of bounded size, each with the three symbols before it."""
    data, margin = (BEGIN * (ORDER - 1) + text).encode("utf-16-le", "surrogatepass"), 2 * (ORDER - 1)
    for at in range(0, len(data) - margin, 2 * chunk):
        yield data[at : at + 2 * chunk + margin]


def keys(parts: list[bytes]) -> np.ndarray:
    """The n-grams that end at each symbol of the parts, one part after the other: the first symbol has the lowest bits."""
    joined = b"".join(parts)
    view = np.ndarray((len(joined) // 2 - ORDER + 1,), "<u8", joined, strides=(2,))
    inside = np.ones(len(view), bool)
    ends = np.cumsum([len(p) // 2 for p in parts[:-1]], dtype=np.int64)
    for i in range(1, ORDER):
        inside[ends - i] = False  # these would span two parts
    return view[inside].view(np.int64)


def chunks(texts: Iterator[str], chunk: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Parts of texts, some chunk symbols at a time, with the number of the text that each part belongs to."""
    owners, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text, chunk):
            owners.append(i)
            parts.append(part)
            held += len(part) // 2
            if held >= chunk:
                yield owners, parts
                owners, parts, held = [], [], 0
    if parts:
        yield owners, parts


class Tally:
    """N-grams and their counts, merged whenever new ones outnumber them."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, found: np.ndarray, weight: int) -> None:
        counted = pa.array(found).value_counts()
        self.waiting.append((counted.field("values").to_numpy(), counted.field("counts").to_numpy() * weight))
        if sum(len(k) for k, _ in self.waiting) > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> int:
        joined = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        self.keys, of = np.unique(joined, return_inverse=True)
        self.counts = np.bincount(of, counts, len(self.keys)).astype(np.int64)
        self.waiting.clear()
        return len(self.keys)


class Beside:
    """Rows that belong to blocks, written a folder for each block, for the tasks that read the block."""

    def __init__(self, rows: DataFrame, label: str) -> None:
        self.path = fresh_path(rows.sparkSession, label)
        rows.repartition("block").write.partitionBy("block").parquet(self.path)

    def of(self, block: int) -> pa.Table | None:
        system, path = opened(f"{self.path}/block={block}")
        found = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
        return pa.concat_tables([pq.read_table(f, filesystem=system, partitioning=None) for f in sorted(found)]) if found else None


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches that hold rows of one block each."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        bounds = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield int(blocks[a]), batch.slice(a, b - a)


def text_print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def written(docs: DataFrame, columns: list[str], id_column: str, text_column: str, lang_column: str) -> tuple[DataFrame, str]:
    """(at, block, doc_id, lang, print, row): the rows in blocks, with the named columns in one struct, whose names can't clash with ours."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("at"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(lang_column).cast("string").alias("lang"),
        text_print(F.col(text_column)).alias("print"),
        F.struct(*columns).alias("row"),
    )
    return staged_at(rows.withColumn("block", F.expr(f"at DIV {BLOCK_ROWS}")), "texts")


def roles(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(at, block, held): one row of each trusted text, held if it is held out.

    Trusted is a document that labels (doc_id, quality, toxic) call good throughout and never toxic.
    """
    good = labels.groupBy("doc_id").agg(F.expr("min(quality) = 1 AND max(toxic) = 0 AND count(*) = count(quality) AND count(*) = count(toxic)").alias("trusted")).where("trusted AND doc_id IS NOT NULL")
    single = rows.select("doc_id", "print", "at", "block").join(good.select("doc_id"), "doc_id").groupBy("print").agg(F.min(F.struct("at", "block")).alias("first"))
    return staged(single.select("first.at", "first.block", F.expr(f"pmod(xxhash64(print, 1), {HOLD_OUT}) = 0").alias("held")), "roles")


def gathered(rows: DataFrame, trained: Beside, text_column: str) -> tuple[DataFrame, str]:
    """(block, g, n): the n-grams of every block, and how often they stand in its training texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ours, tally = None, np.zeros(0, np.int64), Tally()

        def told() -> pa.RecordBatch:
            n = tally.merge()
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, now)), pa.array(tally.keys), pa.array(tally.counts)], ["block", "g", "n"])

        for block, batch in _by_block(batches):
            if block != now:
                if now is not None:
                    yield told()
                beside = trained.of(block)
                now, ours, tally = block, np.sort(beside.column("at").to_numpy()) if beside else np.zeros(0, np.int64), Tally()
            train = np.isin(batch.column("at").to_numpy(), ours)
            texts = [normal(t)[0] for t in batch.column("text").to_pylist()]
            for weight in (0, 1):
                for _, parts in chunks(t for t, x in zip(texts, train, strict=True) if x == weight):
                    tally.add(keys(parts), weight)
            if len(tally.keys) > HELD:
                yield told()
                tally = Tally()
        if now is not None:
            yield told()
        del tally
        release()

    found = rows.select("at", "block", F.col(f"row.`{text_column}`").cast("string").alias("text")).mapInArrow(gather, "block long, g long, n long")
    return staged_at(found, "n-grams")


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts for counts of 1, 2 and more, from how many n-grams occur 1 to 4 times; half a one is added to each.

    >>> [round(d, 3) for d in discounts({1: 100, 2: 40, 3: 20, 4: 10})]
    [0.554, 1.159, 1.866]
    """
    n = [counts_of_counts.get(i, 0) + 0.5 for i in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    found = (i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3))
    return tuple(min(float(i), max(0.05, d)) for i, d in zip((1, 2, 3), found, strict=True))


def shorter(key: str = "g") -> str:
    """An n-gram without its first symbol."""
    return f"shiftrightunsigned({key}, 16)"


def context(order: int, key: str = "g") -> str:
    """An n-gram without its last symbol."""
    return f"{key} & {(1 << 16 * (order - 1)) - 1}L"


class Model:
    """By order: a table of n-grams (g, n), n being continuation counts below the highest order, and one of contexts (c, total, left)."""

    def __init__(self, counts: DataFrame) -> None:
        """counts (g, n): how often each n-gram of the highest order occurs."""
        self.grams: dict[int, DataFrame] = {ORDER: staged(counts, "counts")}
        self.contexts: dict[int, DataFrame] = {}
        self.cuts: dict[int, tuple[float, float, float]] = {}
        for order in range(ORDER, 0, -1):
            table = self.grams[order]
            # at most four rows come to the driver
            d = self.cuts[order] = discounts({r.n: r["count"] for r in table.where("n <= 4").groupBy("n").count().collect()})
            spared = " + ".join(f"{x!r}D * count_if(n {how})" for x, how in zip(d, ("= 1", "= 2", "> 2"), strict=True))
            self.contexts[order] = staged(table.groupBy(F.expr(context(order)).alias("c")).agg(F.sum("n").alias("total"), F.expr(spared).alias("left")), "contexts")
            if order > 1:
                self.grams[order - 1] = staged(table.groupBy(F.expr(shorter()).alias("g")).agg(F.count("*").alias("n")), "counts")

    def answer(self, asked: DataFrame) -> DataFrame:
        """(g, logp) for each of the distinct n-grams asked (g): the interpolated log probability of its last symbol.

        The tables grow with the text and are written small, so they are joined by sorting and not broadcast.
        """
        wanted = {ORDER: asked}
        for order in range(ORDER, 1, -1):
            wanted[order - 1] = wanted[order].select(F.expr(shorter()).alias("g")).distinct()
        known = None
        for order in range(1, ORDER + 1):
            one, two, more = self.cuts[order]
            rows = wanted[order].selectExpr("g", f"{context(order)} AS c", f"{shorter()} AS s").join(self.grams[order].hint("merge"), "g", "left").join(self.contexts[order].hint("merge"), "c", "left")
            if known is None:
                rows = rows.withColumn("p", F.lit(1.0 / SYMBOLS))
            else:
                rows = rows.join(known.withColumnRenamed("g", "s").hint("merge"), "s")
            own = f"coalesce(n - CASE n WHEN 1 THEN {one!r}D WHEN 2 THEN {two!r}D ELSE {more!r}D END, 0D)"
            known = rows.selectExpr("g", f"CASE WHEN total IS NULL THEN p ELSE ({own} + left * p) / total END AS p")
        return known.select("g", F.log("p").alias("logp"))


def surprisals(rows: DataFrame, answers: Beside, text_column: str, carry: bool) -> DataFrame:
    """rows, without the column row unless carry says so, with nll, the sum of each text's surprisals in nats, and n_chars, its length."""
    schema = T.StructType([f for f in rows.schema.fields if carry or f.name != "row"] + [T.StructField("nll", T.DoubleType()), T.StructField("n_chars", T.LongType())])
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, logp = None, np.zeros(0, np.int64), np.zeros(0)
        for block, batch in _by_block(batches):
            if block != now:
                beside = answers.of(block)
                if beside is not None:
                    order = np.argsort(beside.column("g").to_numpy())
                    asked, logp = beside.column("g").to_numpy()[order], beside.column("logp").to_numpy()[order]
                now = block
            texts, lengths = zip(*map(normal, batch.column("row").field(text_column).cast(pa.string()).to_pylist()), strict=True)
            nll = np.zeros(len(texts))
            for owners, parts in chunks(iter(texts)):
                coded = pa.array(keys(parts)).dictionary_encode()
                distinct = coded.dictionary.to_numpy()
                at = np.searchsorted(asked, distinct)
                if not (asked[np.minimum(at, len(asked) - 1)] == distinct).all():
                    raise ValueError(f"block {block} has n-grams that were not asked for")
                begins = np.cumsum([0, *(len(p) // 2 - ORDER + 1 for p in parts[:-1])])
                np.add.at(nll, owners, -np.add.reduceat(logp[at][coded.indices.to_numpy()], begins))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:-2]), pa.array(nll), pa.array(lengths, pa.int64())], names)
        release()

    return rows.mapInArrow(score, schema)


def _quantiles(values: DataFrame, shares: dict[str, float], of: dict[str, str] | None = None) -> DataFrame:
    """(tongue, one column for each share, in thousandths) of values (lang, x): nearest ranks among a language's own, and POOLED of all languages as a weight.

    of: by column, the condition on the values that count for it, all by default. A language without such values gets what all have; where nobody has such values, there is no quantile.
    The tongue '' stands for the null language and any without values: these have all languages' alone. All weights are whole numbers: own counts times
    the number of all, and POOLED times the counts of all.
    """
    counts = values.groupBy(F.coalesce("lang", F.lit("")).alias("tongue"), "x").agg(*[F.count_if(F.expr((of or {}).get(c, "true"))).cast("decimal(38,0)").alias(f"n_{c}") for c in shares])
    every = staged(counts, "values")  # on a grid: bounded for each language
    point = F.struct("x", *[f"n_{c}" for c in shares])
    pooled = every.groupBy("x").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in shares]).agg(*[F.sum(f"n_{c}").alias(f"all_{c}") for c in shares], F.collect_list(point).alias("points"))
    tongues = every.where("tongue <> ''").groupBy("tongue").agg(F.collect_list(point).alias("own"))
    tongues = tongues.unionByName(pooled.select(F.lit("").alias("tongue"), F.expr("filter(points, p -> false)").alias("own"))).join(F.broadcast(pooled))  # one row
    weight = lambda by: ", ".join(f"CAST(p.n_{c} * {by.format(c)} AS decimal(38,0)) AS {c}" for c in shares)
    weights = f"explode(concat(transform(own, p -> (p.x AS x, {weight('all_{}')})), transform(points, p -> (p.x AS x, {weight(str(POOLED))})))) AS p"
    weighted = tongues.selectExpr("tongue", weights).select("tongue", "p.*").groupBy("tongue", "x").agg(*[F.sum(c).alias(c) for c in shares])
    ranked = weighted.selectExpr("tongue", "x", *[f"sum({c}) OVER (PARTITION BY tongue ORDER BY x) AS upto_{c}" for c in shares], *[f"sum({c}) OVER (PARTITION BY tongue) AS total_{c}" for c in shares])
    least = [F.min(F.expr(f"CASE WHEN total_{c} > 0 AND upto_{c} >= {share!r}BD * total_{c} THEN x END")).alias(c) for c, share in shares.items()]
    return staged(ranked.groupBy("tongue").agg(*least), "by-language")  # a row a language: its size is known once it is written


def _with(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """rows with the columns of their language in table (tongue, names), or of the tongue '' where it has none."""
    own = table.where("tongue <> ''")
    rest = table.where("tongue = ''").select(F.lit(True).alias("_other"), *[F.col(x).alias(f"_{x}") for x in names])
    joined = rows.withColumn("tongue", F.coalesce("lang", F.lit(""))).join(own, "tongue", "left")
    joined = joined.withColumn("_other", F.col(names[0]).isNull()).join(rest, "_other", "left")
    return joined.select(*rows.columns, *[F.coalesce(x, f"_{x}").alias(x) for x in names])


def _judged(docs: DataFrame, labels: DataFrame, columns: list[str], carry: bool, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    rows, rows_path = written(docs, columns, id_column, text_column, lang_column)
    trusted = roles(rows, labels)
    grams, grams_path = gathered(rows, Beside(trusted.where("NOT held").select("block", "at"), "training"), text_column)
    forget(docs.sparkSession)  # here and below: the plans of a part that is done are many, and the next ones would come on top of them in the driver
    model = Model(grams.where("n > 0").groupBy("g").agg(F.sum("n").alias("n")))
    forget(docs.sparkSession)
    answers = model.answer(grams.select("g").distinct())
    beside = Beside(grams.select("block", "g").join(answers.hint("merge"), "g"), "answers")
    scored = staged(surprisals(rows, beside, text_column, carry), "surprisals")
    remove(docs.sparkSession, rows_path, grams_path, beside.path)  # nothing reads them any more
    forget(docs.sparkSession)
    known = scored.select("at", "lang", "nll", "n_chars").where("n_chars > 0").join(trusted.select("at", "held"), "at")
    grid = "CAST(round(1000 * {}) AS bigint) AS x"
    middle = _quantiles(known.selectExpr("lang", grid.format("nll / n_chars")), {"middle": 0.5})
    level = f"(nll + {PRIOR} * middle / 1000) / (n_chars + {PRIOR})"
    scored = _with(scored, middle, "middle").withColumn("level", F.expr(level))
    known = staged(_with(known, middle, "middle").selectExpr("lang", "held", grid.format(level)), "levels")
    return _with(scored, _quantiles(known, {"low": BEYOND, "high": 1 - BEYOND}, {"high": "held"}), "low", "high")


#: A text is kept if its level, on the thresholds' grid, lies between them.
KEEP = "n_chars > 0 AND (low IS NULL OR round(1000 * level) >= low) AND (high IS NULL OR round(1000 * level) <= high)"


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, level, low, high, keep) for every row of docs.

    perplexity is that of the text's own symbols, by its length in characters. level is the perplexity
    with PRIOR symbols of the language's median surprisal added, so that a few characters alone reject none; keep is
    whether it lies between low, the language's quantile BEYOND of the levels of trusted texts, and high, the quantile 1 - BEYOND of held-out ones.
    Levels and thresholds are rounded to a thousandth of a nat before they are compared.

    Trusted are the documents that labels (doc_id, quality, toxic) call good throughout
    and never toxic; of rows with equal texts one counts. A text without words, as a null one, has no perplexity and is not
    kept. Without a trusted text there are no thresholds, without a held-out one no high one, and all others are kept. A language without one,
    and the null language, have the thresholds of all.
    Null ids are never trusted; repeated rows come out as such and ties do not matter; texts of any length are read whole, in
    parts; an empty table gives an empty result; other columns are left out, whatever their names.
    """
    columns = list(dict.fromkeys([id_column, text_column, lang_column]))
    out = _judged(docs, labels, columns, False, id_column, text_column, lang_column)
    exp = lambda x: F.round(F.exp(F.expr(x)), 6)
    return out.select("doc_id", "lang", "n_chars", exp("nll / nullif(n_chars, 0)").alias("perplexity"), exp("round(level, 3)").alias("level"), exp("low / 1000").alias("low"), exp("high / 1000").alias("high"), F.expr(KEEP).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names."""
    return _judged(docs, labels, docs.columns, True, id_column, text_column, lang_column).where(KEEP).select("row.*")
