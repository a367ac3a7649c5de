"""Queries of linked groups, splits and lexical features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, lexical, linear
from ..sources.shared import staged
from .agreement import rounded
from .bindings import PASSAGES_SQL, containing, passages, table
from .registry import registered


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: documents with their keys: whole text, both ends, a contained benchmark item."""
    docs = table(spark, sf_dir, "documents")
    items = containing(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))).groupBy("doc_id").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    low = F.lower("text")
    ends = docs.select("doc_id", "lang", F.sha2(low, 256).alias("whole"), F.substring(low, 1, 40).alias("head"), F.right(low, F.lit(40)).alias("tail"))
    return ends.join(items, "doc_id", "left")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir)
    # a document with several items stands in a row for each; rows of one id are linked by it
    flat = rows.select("doc_id", "whole", "head", "tail", F.explode_outer("items").alias("item"))
    return graph.grouped(flat, "doc_id", {k: F.col(k) for k in ("whole", "head", "tail", "item")})


_KEYED = "keyed AS (SELECT doc_id, 'w' || lower(text) AS k FROM documents UNION SELECT doc_id, 'h' || left(lower(text), 40) FROM documents UNION SELECT doc_id, 't' || right(lower(text), 40) FROM documents UNION SELECT doc_id, 'i' || item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
GROUPS_SQL = f"""WITH RECURSIVE {_KEYED}, least AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k), links AS MATERIALIZED (SELECT DISTINCT doc_id AS a, m AS b FROM keyed JOIN least USING (k) WHERE doc_id <> m),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a),
members AS MATERIALIZED (SELECT node AS doc_id, min(seen) AS grp FROM reach GROUP BY node)"""


@registered("components", GROUPS_SQL + ' SELECT doc_id, grp AS "group" FROM members')
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir)


@registered("component_sizes", GROUPS_SQL + " SELECT n AS size, count(*) AS groups FROM (SELECT count(*) AS n FROM members GROUP BY grp) GROUP BY n")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).groupBy("group").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@registered("group_rows", GROUPS_SQL + """ SELECT grp AS "group", count(*) AS size, array_to_string(list_sort(list(doc_id)), ',') AS member_ids, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other FROM members JOIN documents USING (doc_id) GROUP BY grp""")
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a group with its members; the arrays are as large as the groups."""
    rows = members(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("group").agg(F.count("*").alias("size"), ids.alias("member_ids"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"))


_FAULTY = "faulty AS (SELECT doc_id, CASE WHEN doc_id % 40 = 3 THEN -doc_id ELSE grp END AS grp FROM members WHERE doc_id % 60 <> 5 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id % 70 = 9)"


@registered(
    "group_constraints",
    GROUPS_SQL
    + f""", {_FAULTY} SELECT 'exclusive' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM faulty GROUP BY doc_id HAVING count(DISTINCT grp) > 1))::BIGINT AS faults
UNION ALL SELECT 'covered', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM faulty))::BIGINT
UNION ALL SELECT 'one_group_a_key', (SELECT count(*) FROM (SELECT k FROM keyed JOIN faulty USING (doc_id) GROUP BY k HAVING count(DISTINCT grp) > 1))::BIGINT""",
)
def group_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with faults put into them: ids that left theirs, ids in none, ids in two."""
    rows = keyed(spark, sf_dir)
    kinds = [F.concat(F.lit("w"), "whole"), F.concat(F.lit("h"), "head"), F.concat(F.lit("t"), "tail")]
    keys = rows.select("doc_id", F.explode(F.concat(F.array(*kinds), F.coalesce(F.transform("items", lambda x: F.concat(F.lit("i"), x)), F.array().cast("array<string>")))).alias("key"))
    kept = members(spark, sf_dir).where("doc_id % 60 <> 5").withColumn("group", F.expr("CASE WHEN doc_id % 40 = 3 THEN -doc_id ELSE `group` END"))
    twice = table(spark, sf_dir, "documents").where("doc_id % 70 = 9").select("doc_id", F.lit(-1).cast("long").alias("group"))
    return graph.constraint_faults(staged(kept.unionByName(twice), "members"), keys, "doc_id")


_TARGETS = "c AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang), p AS (SELECT lang, total, split, num, i, total * num // 100 AS f, total * num % 100 AS r FROM c, (VALUES (0, 'train', 70), (1, 'validation', 15), (2, 'test', 15)) AS v(i, split, num)), targets AS (SELECT lang, split, f + (row_number() OVER (PARTITION BY lang ORDER BY r DESC, i) <= total - sum(f) OVER (PARTITION BY lang))::BIGINT AS target FROM p)"


@registered("stratified_targets", f"WITH {_TARGETS} SELECT lang, split, target FROM targets")
def stratified_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.split_targets(table(spark, sf_dir, "documents"), "lang")


@registered("largest_remainder", "WITH c AS (SELECT o_orderpriority, count(*) AS total FROM orders GROUP BY 1), p AS (SELECT *, total * num // 7 AS f, total * num % 7 AS r FROM c, (VALUES ('a', 4), ('b', 2), ('c', 1)) AS v(part, num)) SELECT o_orderpriority, part, f + (row_number() OVER (PARTITION BY o_orderpriority ORDER BY r DESC, part) <= total - sum(f) OVER (PARTITION BY o_orderpriority))::BIGINT AS share FROM p")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import numeric

    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"))
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("part"), F.lit(n).alias("num"), F.lit(7).alias("den")) for x, n in (("a", 4), ("b", 2), ("c", 1))])).alias("p")
    rows = counts.select("o_orderpriority", "total", parts).select("o_orderpriority", "total", "p.*")
    return numeric.largest_remainder(rows, ["o_orderpriority"], "total", "part", ("num", "den"), "part").select("o_orderpriority", "part", "share")


@registered("group_split_check", f"WITH {_TARGETS}, sums AS (SELECT split, sum(target)::BIGINT AS want FROM targets GROUP BY split) SELECT split, want, true AS whole, true AS near FROM sums")
def group_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups are divided: a row a split with its target, whether no group of it is in another, and whether its size is as near as the largest group lets it be."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = staged(members(spark, sf_dir).join(docs, "doc_id"), "members")
    targets = staged(graph.split_targets(docs, "lang"), "targets")
    split = staged(graph.assign_splits(rows, targets, "lang"), "splits")
    met = rows.join(split, "group", "left")
    twice = split.groupBy("group").agg(F.count("*").alias("n"), F.min("split").alias("split")).groupBy("split").agg(F.max("n").alias("most"))
    largest = rows.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    sizes = met.groupBy("split").agg(F.count("*").alias("have")).join(targets.groupBy("split").agg(F.sum("target").alias("want")), "split").join(twice, "split")
    return sizes.join(F.broadcast(largest)).select("split", "want", (F.col("most") == 1).alias("whole"), (F.abs(F.col("have") - F.col("want")) <= F.col("largest") + 5).alias("near"))


_FOLDS = GROUPS_SQL + """, per AS (SELECT grp, lang, count(*) AS c FROM members JOIN documents USING (doc_id) GROUP BY ALL), shape AS (SELECT grp, sum(c)::BIGINT AS size, array_to_string(list_sort(list(lang || ':' || c)), ',') AS kind FROM per GROUP BY grp),
placed AS (SELECT *, row_number() OVER (ORDER BY size DESC, kind, sha256('2026|' || grp), grp) - 1 AS place FROM shape), folds AS (SELECT grp, (CASE WHEN (place // 5) % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END)::BIGINT AS fold FROM placed)"""


@registered("group_folds", _FOLDS + ' SELECT grp AS "group", fold FROM folds')
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of every group; groups of a size and the same languages stand together and are dealt to all folds."""
    rows = members(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return graph.folds(staged(rows, "members"), 5, "2026", "lang")


@registered("fold_labels", _FOLDS + " SELECT fold, lang, count(*) AS n FROM members JOIN folds USING (grp) JOIN documents USING (doc_id) GROUP BY ALL")
def fold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(members(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), "members")
    return rows.join(graph.folds(rows, 5, "2026", "lang"), "group").groupBy("fold", "lang").agg(F.count("*").alias("n"))


@registered("inner_folds", _FOLDS + " SELECT o.k AS held, (SELECT count(*) FROM folds f WHERE f.fold <> o.k) AS groups, 4::BIGINT AS inner_folds, 0::BIGINT AS leaks FROM (SELECT unnest(range(5)) AS k) o")
def inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fold that is held out: the groups of the others, how many inner folds they have, and how many groups are in two or in the held fold."""
    rows = staged(members(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), "members")
    found = staged(graph.nested_folds(rows, 5, 4, "2026", "lang"), "inner-folds")
    each = found.groupBy("held", "group").agg(F.count("*").alias("n"), F.max(F.col("fold") == F.col("held")).alias("leak"))
    leaks = each.groupBy("held").agg(F.count("*").alias("groups"), F.count_if((F.col("n") > 1) | F.col("leak")).alias("leaks"))
    return leaks.join(found.groupBy("held").agg(F.count_distinct("inner_fold").alias("inner_folds")), "held").select("held", "groups", "inner_folds", "leaks")


@registered(
    "selection_by_flow",
    """WITH k AS (SELECT DISTINCT user_id, event_type FROM events), types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)), m AS (SELECT count(*) AS types FROM types),
subsets AS (SELECT unnest(range((1 << types)::BIGINT)) AS mask, types FROM m), masks AS (SELECT user_id, sum(1 << i)::BIGINT AS offer FROM k JOIN types USING (event_type) GROUP BY user_id)
SELECT min(15 * (types - bit_count(mask)) + (SELECT count(*) FROM masks WHERE offer & mask > 0))::BIGINT AS selected, min(15 * (types - bit_count(mask)) + (SELECT count(*) FROM masks WHERE offer & mask > 0))::BIGINT AS keys, true AS within FROM subsets""",
)
def selection_by_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to fifteen events of each type, no user twice: as many as any choice has, by Hall's condition over all sets of types; and no type has more."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    chosen = staged(graph.one_row_a_key(events, "event_id", "user_id", "event_type", 15, "9"), "chosen")
    most = chosen.groupBy("event_type").agg(F.count("*").alias("n")).agg((F.max("n") <= 15).alias("within"))
    return chosen.agg(F.count("*").alias("selected"), F.count_distinct("user_id").alias("keys")).join(most)


_COUNTS = "SELECT {id} AS id, term, count(*) AS tf FROM (SELECT {id}, unnest(regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿ]+')) AS term FROM {t}) GROUP BY ALL"


@registered(
    "pair_tfidf",
    PASSAGES_SQL
    + f""", dc AS MATERIALIZED ({_COUNTS.format(id="doc_id", t="documents")}), ic AS ({_COUNTS.format(id="item_id", t="benchmark")}),
idf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dc GROUP BY term HAVING count(*) >= 2),
dr AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM dc JOIN idf USING (term)), dw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM dr),
ir AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM ic JOIN idf USING (term)), iw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM ir),
sides AS (SELECT doc_id, item_id, term, w AS p, 0 AS h FROM met JOIN dw ON id = doc_id UNION ALL SELECT doc_id, item_id, term, 0, w FROM met JOIN iw ON id = item_id),
cells AS (SELECT doc_id, item_id, term, sum(p) AS p, sum(h) AS h FROM sides GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS terms, round(sum(abs(p - h)), 6) AS difference, round(sum(p * h), 6) AS product FROM cells GROUP BY ALL""",
)
def pair_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    counts = lexical.term_counts(docs, "doc_id", "text")
    idf = lexical.inverse_frequencies(counts, docs)
    pairs = staged(passages(spark, sf_dir).select("doc_id", "item_id"), "pairs")
    # frequencies are those of all documents, but only the paired ones are weighed
    left = lexical.weights(lexical.term_counts(docs.join(pairs.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text"), idf, "doc_id")
    right = lexical.weights(lexical.term_counts(items, "item_id", "text"), idf, "item_id")
    cells = lexical.pair_features(pairs, left, right, "doc_id", "item_id")
    return rounded(cells.groupBy("doc_id", "item_id").agg(F.count("*").alias("terms"), F.sum("difference").alias("difference"), F.sum("product").alias("product")), "difference", "product")


_WORDS = "SELECT item_id, unnest(list_concat(list_transform(w, lambda x: 'w ' || x), list_transform(range(1, len(w)), lambda i: 'w ' || w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿ]+') AS w FROM benchmark)"
_CHARS = " UNION ALL ".join(f"SELECT item_id, 'c' || substring(p, i, {n}) FROM (SELECT item_id, p, unnest(range(1, greatest(1, length(p) - {n - 1}) + 1)) AS i FROM padded WHERE length(p) >= {n}{' OR true' if n == 3 else ''})" for n in (3, 4, 5))


@registered("gram_features", f"WITH padded AS (SELECT item_id, ' ' || unnest(regexp_extract_all(lower(text), '\\S+')) || ' ' AS p FROM benchmark), terms AS ({_WORDS} UNION ALL {_CHARS}) SELECT item_id, term, count(*) AS tf FROM terms GROUP BY ALL")
def gram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one and two words, and of three to five characters inside words with their borders, of the benchmark's texts."""
    return lexical.gram_counts(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


@registered(
    "token_windows",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - 64) / 48.0) + 1)::BIGINT)) AS win FROM w)
SELECT doc_id, win AS "window", win * 48 + 1 AS first, least(win * 48 + 64, len(w)) AS last, sha256(array_to_string(w[win * 48 + 1 : least(win * 48 + 64, len(w))], ' ')) AS content FROM s""",
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.token_windows(table(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text")), 64, 48)
    return rows.select("doc_id", F.col("window").cast("long").alias("window"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.sha2(F.array_join("words", " "), 256).alias("content"))


@registered(
    "supervised_windows",
    PASSAGES_SQL
    + """, spanned AS (SELECT doc_id, item_id, len(regexp_extract_all(substring(text, 1, start::INT), '\\S+')) + CASE WHEN start > 0 AND regexp_matches(substring(text, start::INT, 2), '^\\S\\S') THEN 0 ELSE 1 END AS gold_first, len(regexp_extract_all(substring(text, 1, stop::INT), '\\S+')) AS gold_last FROM met),
gold AS (SELECT doc_id, min({'a': gold_first, 'b': gold_last}) AS g FROM spanned GROUP BY doc_id), w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, unnest(range(greatest(1, ceil((len(w) - 64) / 48.0) + 1)::BIGINT)) AS win FROM w),
bounds AS (SELECT doc_id, win, win * 48 + 1 AS first, least(win * 48 + 64, n) AS last FROM s), marked AS (SELECT b.*, CASE WHEN g.a >= first AND g.b <= last THEN g.a - first + 1 END AS s1, CASE WHEN g.a >= first AND g.b <= last THEN g.b - first + 1 END AS e1 FROM bounds b LEFT JOIN gold USING (doc_id))
SELECT doc_id, win AS "window", s1 AS "start", e1 AS "end", count(s1) OVER (PARTITION BY doc_id) AS positive FROM marked""",
)
def supervised_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 words with the place of the document's first contained passage, where a window holds all of it."""
    docs = table(spark, sf_dir, "documents")
    met = passages(spark, sf_dir).withColumn("s", text.token_span(F.col("text"), F.col("start"), F.col("end")))
    gold = met.groupBy("doc_id").agg(F.min(F.struct(F.col("s.first").alias("a"), F.col("s.last").alias("b"))).alias("g")).select("doc_id", F.col("g.a").alias("gold_first"), F.col("g.b").alias("gold_last"))
    windows = lexical.token_windows(docs, "doc_id", text.words(F.col("text")), 64, 48).drop("words")
    marked = lexical.supervised_windows(windows, gold, "doc_id")
    return marked.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("window", "start", "end", "positive")])


@registered(
    "window_batches",
    """WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, greatest(1, ceil((len(regexp_extract_all(text, '\\S+')) - 64) / 48.0) + 1)::BIGINT AS n FROM documents),
fill(i, batch, items, used) AS (SELECT 1::BIGINT, 0::BIGINT, 1, (SELECT n FROM sized WHERE i = 1) UNION ALL SELECT s.i, CASE WHEN f.items = 16 OR f.used + s.n > 64 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.items = 16 OR f.used + s.n > 64 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items = 16 OR f.used + s.n > 64 THEN s.n ELSE f.used + s.n END FROM fill f JOIN sized s ON s.i = f.i + 1)
SELECT doc_id, batch FROM fill JOIN sized USING (i)""",
)
def window_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = lexical.token_windows(table(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text")), 64, 48)
    sizes = windows.groupBy("doc_id").agg(F.count("*").alias("windows"))
    return lexical.window_batches(sizes, "doc_id", "windows", 16, 64)


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality")


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of all documents, and (doc_id, quality, size) of the labelled ones; texts stay where they are."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return docs.select("doc_id", "text"), sizes.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


#: Seeds of the repeats of outer folds.
REPEATS = ("2026", "2027", "2028")

#: The choices that inner folds are for: each penalty with classes as they are and balanced.
GRID = tuple((penalty, balanced) for penalty in (0.01, 0.1) for balanced in (False, True))


@registered("lexical_baseline")
def lexical_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a document's being good, by its runs of words and characters: the mean over three divisions into folds of the models that have not seen its fold.

    Linked documents are in one fold, inner ones too; terms, their frequencies, the choice of the penalty and the model come from the training texts alone.
    """
    docs, rows = _sized(spark, sf_dir)
    groups = staged(members(spark, sf_dir).join(rows.select("doc_id", "quality"), "doc_id"), "rated-groups")
    plans = [staged(graph.nested_folds(groups, 3, 2, seed, "quality").join(groups.select("doc_id", "group"), "group").select("doc_id", "fold", "held", "inner_fold"), "nested-folds") for seed in REPEATS]
    scored = linear.out_of_fold(docs, rows, plans, "quality", "doc_id", F.col("text"), GRID, 2, 0.995)
    return rounded(scored, "probability", places=4)


_TEXTS = "rated AS MATERIALIZED (SELECT doc_id, quality, text FROM documents JOIN labels USING (doc_id))"
_RATED_WORDS = "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(list_transform(w, lambda x: 'w ' || x), list_transform(range(1, len(w)), lambda i: 'w ' || w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9à-öø-ÿ]+') AS w FROM rated)) GROUP BY ALL"


@registered(
    "training_terms",
    f"""WITH {_TEXTS}, terms AS MATERIALIZED ({_RATED_WORDS}), plan AS (SELECT doc_id, held, ((doc_id // 3) % 2)::BIGINT AS inner_fold FROM rated, (SELECT unnest(range(3)) AS held) WHERE doc_id % 3 <> held),
sets AS (SELECT held, without, (SELECT count(*) FROM plan p WHERE p.held = h.held AND p.inner_fold <> without) AS n FROM (SELECT unnest(range(3)) AS held) h, (SELECT unnest([-1, 0, 1])::BIGINT AS without)),
counted AS (SELECT s.held, without, term, max(n) AS n, count(*) AS df, sum(tf) AS tf FROM sets s JOIN plan p ON p.held = s.held AND p.inner_fold <> without JOIN terms USING (doc_id) GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY held, without ORDER BY tf DESC, term) AS r FROM counted WHERE df >= 2 AND df <= 0.5 * n)
SELECT held, without, term, round(ln((1 + n) / (1 + df)::DOUBLE) + 1, 6) AS idf FROM kept WHERE r <= 2000""",
)
def training_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most frequent runs of words of each training set of three outer and two inner folds, in half of its texts at most, and their weights."""
    rows = _rated(spark, sf_dir)
    counts = staged(lexical.gram_counts(rows, "doc_id", F.col("text")).where("term LIKE 'w%'"), "word-grams")
    plan = rows.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("held")).where("doc_id % 3 <> held").withColumn("inner_fold", F.expr("(doc_id DIV 3) % 2"))
    return rounded(lexical.training_terms(counts, staged(plan, "fold-plan"), "doc_id", lexical.Limits(2, 0.5, 2000)), "idf")


@registered("refitted_terms")
def refitted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that speak most for either class, of the model of all labelled documents."""
    docs, rows = _sized(spark, sf_dir)
    terms = linear.refitted(docs, rows, "quality", "doc_id", F.col("text"))[0]
    return rounded(linear.best_terms(terms, 60), "coefficient", places=4)


@registered("unseen_predictions")
def unseen_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that each unlabelled document is good, by the model of all labelled ones and their terms."""
    docs, rows = _sized(spark, sf_dir)
    terms, intercept, parts, _ = linear.refitted(docs, rows, "quality", "doc_id", F.col("text"))
    others = docs.select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").toArrow().column(0).combine_chunks()
    return rounded(linear.predicted(docs, "doc_id", F.col("text"), terms, intercept, parts, others), "probability", places=4)
