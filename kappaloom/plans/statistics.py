"""Queries of tests, percentiles and resampling. Replicates are few here, so that the SQL beside them stays quick; the number is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import audit, resample
from .agreement import FLIPS_SQL, rounded
from .bindings import PAIRED_SQL, paired, table, variants
from .registry import registered

SEED, REPS = "2026", 100


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: market segment and priority of every order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderpriority")


_CHI = """WITH s AS (SELECT c_mktsegment AS g, o_orderpriority AS l FROM orders JOIN customer ON o_custkey = c_custkey), o AS (SELECT g, l, count(*) AS o FROM s GROUP BY ALL), r AS (SELECT g, count(*) AS r FROM s GROUP BY g), c AS (SELECT l, count(*) AS c FROM s GROUP BY l), n AS (SELECT count(*) AS n FROM s),
x AS (SELECT sum((coalesce(o, 0) - r * c / n::DOUBLE) ** 2 / (r * c / n::DOUBLE)) AS chi2, max(n) AS n, (SELECT count(*) FROM r) AS groups, (SELECT count(*) FROM c) AS labels FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o USING (g, l))"""


@registered("chi_square", _CHI + " SELECT n, groups, labels, round(chi2, 6) AS chi2 FROM x")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.chi_square(segments(spark, sf_dir), "c_mktsegment", "o_orderpriority").drop("cramers_v"), "chi2")


@registered("cramers_v", _CHI + " SELECT round(sqrt(chi2 / (n * (least(groups, labels) - 1))), 6) AS cramers_v FROM x")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.chi_square(segments(spark, sf_dir), "c_mktsegment", "o_orderpriority").select("cramers_v"), "cramers_v")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7: two raters of the labelled documents, in the agreement operators' columns."""
    name = lambda x: F.when(F.col(x) == 1, "entailment").otherwise("contradiction")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.select("doc_id", "lang", "source", "quality", "toxic", name("quality").alias("gold"), name("toxic").alias("pred"))


_RATED = "rated AS MATERIALIZED (SELECT doc_id, lang, source, quality, toxic FROM labels JOIN documents USING (doc_id))"
_REPS = f"SELECT unnest(range(1, {REPS} + 1)) AS rep"


def _uniform(*parts: str) -> str:
    return f"(('0x' || substr(sha256('{SEED}|' || {" || '|' || ".join(parts)}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def _walked(b: int, u: str, mode: str, variance: str, least: str, most: str, mass: str, keys: str) -> str:
    """From open{b} (keys, parameters) the CTE drawn{b} (keys, x): outcomes around the mode whose distribution function is at most u."""
    return f"""bounds{b} AS (SELECT *, {u} AS u, least({most}, greatest({least}, {mode})) AS mode, ceil(9 * sqrt({variance}) + 12)::BIGINT AS reach FROM open{b}),
masses{b} AS (SELECT {keys}, u, low, {mass} AS m, k FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM (SELECT *, greatest({least}, mode - reach)::BIGINT AS low, least({most}, mode + reach)::BIGINT AS high FROM bounds{b}))),
drawn{b} AS MATERIALIZED (SELECT {keys}, least(max(k), low + count(*) FILTER (f <= u))::BIGINT AS x FROM (SELECT *, sum(m) OVER (PARTITION BY {keys} ORDER BY k) AS f FROM masses{b}) GROUP BY {keys}, low)"""


def _tree(bits: int = 10, strata: bool = False) -> str:
    """CTEs that walk the tree of binomial halves over kinds (s, rank, c), to drawn (rep, s, rank, n)."""
    out = [f"t{bits} AS (SELECT rep, s, 0::BIGINT AS node, n FROM (SELECT s, sum(c)::BIGINT AS n FROM kinds GROUP BY s), ({_REPS}))"]
    choose = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)"
    for b in range(bits - 1, -1, -1):
        u = _uniform(*["s"][: int(strata)], "rep", f"'{b}'", "node")
        out += [
            f"half{b} AS (SELECT s, rank >> {b + 1} AS node, sum(c)::BIGINT AS w, sum(CASE WHEN (rank >> {b}) % 2 = 0 THEN c ELSE 0 END)::BIGINT AS l FROM kinds GROUP BY ALL)",
            f"asked{b} AS MATERIALIZED (SELECT * FROM t{b + 1} JOIN half{b} USING (s, node))",
            f"open{b} AS (SELECT * FROM asked{b} WHERE l > 0 AND l < w)",
            _walked(b, u, "floor((n + 1) * (l / w::DOUBLE))::BIGINT", "n * (l / w::DOUBLE) * ((w - l) / w::DOUBLE)", "0", "n", f"exp({choose} + k * ln(l / w::DOUBLE) + (n - k) * ln((w - l) / w::DOUBLE))", "rep, s, node"),
            f"split{b} AS (SELECT rep, s, node, n, CASE WHEN l = 0 THEN 0 WHEN l = w THEN n ELSE x END AS x FROM asked{b} LEFT JOIN drawn{b} USING (rep, s, node))",
            f"t{b} AS MATERIALIZED (SELECT * FROM (SELECT rep, s, 2 * node AS node, x AS n FROM split{b} UNION ALL SELECT rep, s, 2 * node + 1, n - x FROM split{b}) WHERE n > 0)",
        ]
    return ", ".join([*out, "drawn AS (SELECT rep, s, node AS rank, n FROM t0)"])


def _kinds(source: str, cells: str, stratum: str = "''") -> str:
    return f"kinds AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {cells}) - 1 AS rank FROM (SELECT {stratum} AS s, {cells}, count(*) AS c FROM {source} GROUP BY ALL))"


def _shuffled(bits: int = 3) -> str:
    """CTEs that draw tables of lang and quality from their margins, to shuffled (rep, g, l, o)."""
    out = [
        "groups AS MATERIALIZED (SELECT lang AS g, count(*) AS r, row_number() OVER (ORDER BY lang) - 1 AS rank FROM rated GROUP BY lang)",
        f"t{bits} AS (SELECT rep, 0::BIGINT AS node, v0, v1 FROM (SELECT count(*) FILTER (quality = 0) AS v0, count(*) FILTER (quality = 1) AS v1 FROM rated), ({_REPS}))",
    ]
    choose = lambda n, k: f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
    for b in range(bits - 1, -1, -1):
        out += [
            f"asked{b} AS MATERIALIZED (SELECT *, v0 + v1 AS w FROM t{b + 1} JOIN (SELECT rank >> {b + 1} AS node, sum(CASE WHEN (rank >> {b}) % 2 = 0 THEN r ELSE 0 END)::BIGINT AS m FROM groups GROUP BY 1) USING (node))",
            f"open{b} AS (SELECT *, greatest(0, m + v0 - w) AS least, least(m, v0) AS most FROM asked{b})",
            _walked(b, _uniform("rep", f"'{b}'", "node", "'0'"), "floor((m + 1)::DOUBLE * (v0 + 1) / (w + 2))::BIGINT", "m * (v0 / w::DOUBLE) * (1 - v0 / w::DOUBLE) * (w - m) / greatest(1, w - 1)", "least", "most", f"exp({choose('v0', 'k')} + {choose('(w - v0)', '(m - k)')} - ({choose('w', 'm')}))", "rep, node"),
            f"t{b} AS MATERIALIZED (SELECT * FROM (SELECT rep, 2 * node AS node, x AS v0, m - x AS v1 FROM asked{b} JOIN drawn{b} USING (rep, node) UNION ALL SELECT rep, 2 * node + 1, v0 - x, v1 - (m - x) FROM asked{b} JOIN drawn{b} USING (rep, node)) WHERE v0 + v1 > 0)",
        ]
    return ", ".join([*out, "shuffled AS (SELECT * FROM (SELECT rep, g, unnest([0, 1]) AS l, unnest([v0, v1]) AS o FROM t0 JOIN groups ON rank = node) WHERE o > 0)"])


@registered("permutation_tables", f"WITH {_RATED}, {_shuffled()} SELECT rep, g AS lang, l AS quality, o FROM shuffled")
def permutation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of language and quality that shuffled labels make, a row for each replicate and cell."""
    cells = rated(spark, sf_dir).groupBy("lang", "quality").agg(F.count("*").alias("o"))
    return resample.shuffled_tables(cells, "lang", "quality", REPS, SEED).select(F.col("rep").cast("long").alias("rep"), "lang", "quality", "o")


@registered(
    "permutation_p",
    f"""WITH {_RATED}, {_shuffled()}, seen AS (SELECT lang AS g, quality AS l, count(*) AS o FROM rated GROUP BY ALL),
g AS (SELECT lang AS g, count(*) AS r FROM rated GROUP BY 1), l AS (SELECT quality AS l, count(*) AS c FROM rated GROUP BY 1), n AS (SELECT count(*) AS n FROM rated),
chi AS (SELECT rep, max(n) * (sum(o::DOUBLE * o / r / c) - 1) AS x FROM shuffled JOIN g USING (g) JOIN l USING (l) CROSS JOIN n GROUP BY rep), own AS (SELECT max(n) * (sum(o::DOUBLE * o / r / c) - 1) AS x FROM seen JOIN g USING (g) JOIN l USING (l) CROSS JOIN n)
SELECT round(max(own.x), 6) AS chi2, count(*) FILTER (round(chi.x, 9) >= round(own.x, 9)) AS exceed, round((count(*) FILTER (round(chi.x, 9) >= round(own.x, 9)) + 1) / ({REPS} + 1)::DOUBLE, 6) AS p FROM chi CROSS JOIN own""",
)
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.permutation_p(rated(spark, sf_dir), "lang", "quality", REPS, SEED), "chi2", "p")


@registered(
    "mcnemar",
    PAIRED_SQL
    + """, d AS (SELECT seed, gold, count(*) FILTER (pred = gold AND pred2 <> gold) AS b, count(*) FILTER (pred <> gold AND pred2 = gold) AS c FROM paired GROUP BY ALL),
tail AS (SELECT seed, gold, b, c, (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM (SELECT unnest(range(least(b, c) + 1)) AS i)) AS s FROM d)
SELECT seed, gold, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * s) END, 6) AS p FROM tail""",
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    right, right2 = F.col("pred") == F.col("gold"), F.col("pred2") == F.col("gold")
    counts = paired(spark, sf_dir).groupBy("seed", "gold").agg(F.count_if(right & ~right2).alias("b"), F.count_if(~right & right2).alias("c"))
    return rounded(counts.withColumn("p", numeric.mcnemar_p(F.col("b"), F.col("c"))), "p")


_DRAWN = f"{_kinds('rated', 'quality, toxic')}, {_tree()}, draws AS (SELECT rep, quality, toxic, n FROM drawn JOIN kinds USING (s, rank))"
_CHANCE = "(sum(n * quality) / sum(n) * sum(n * toxic) / sum(n) + sum(n * (1 - quality)) / sum(n) * sum(n * (1 - toxic)) / sum(n))"
_KAPPA = f"((sum(n * (quality = toxic)::INT) / sum(n) - {_CHANCE}) / (1 - {_CHANCE}))"
_INTERVAL = " SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM reps"


@registered("bootstrap_tables", f"WITH {_RATED}, {_DRAWN} SELECT rep, quality, toxic, n AS c FROM draws")
def bootstrap_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each replicate draws each pair of ratings."""
    return resample.drawn(rated(spark, sf_dir), ["quality", "toxic"], REPS, SEED).select(F.col("rep").cast("long").alias("rep"), "quality", "toxic", "c")


@registered("bootstrap_kappa", f"WITH {_RATED}, {_DRAWN}, reps AS (SELECT rep, {_KAPPA} AS v FROM draws GROUP BY rep)" + _INTERVAL)
def bootstrap_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.bootstrap_kappa(rated(spark, sf_dir), REPS, SEED), "low", "high")


@registered(
    "bootstrap_kappa_stratified",
    f"""WITH {_RATED}, {_kinds('rated', 'quality, toxic', "CASE quality WHEN 1 THEN 'entailment' ELSE 'contradiction' END")}, {_tree(strata=True)},
reps AS (SELECT rep, {_KAPPA} AS v FROM drawn JOIN kinds USING (s, rank) GROUP BY rep)"""
    + _INTERVAL,
)
def bootstrap_kappa_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.bootstrap_kappa(rated(spark, sf_dir), REPS, SEED, ["gold"]), "low", "high")


@registered("bootstrap_mean", f"WITH {_RATED}, {_kinds('rated', 'quality')}, {_tree()}, reps AS (SELECT rep, sum(n * quality) / sum(n) AS v FROM drawn JOIN kinds USING (s, rank) GROUP BY rep)" + _INTERVAL)
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.bootstrap_mean(rated(spark, sf_dir), "quality", REPS, SEED), "low", "high")


@registered(
    "bootstrap_cases",
    FLIPS_SQL
    + f""", cases AS (SELECT base_id, avg(flip) AS f FROM flagged GROUP BY base_id), {_kinds('cases', 'f')}, {_tree()},
reps AS (SELECT rep, sum(n * f) / sum(n) AS v FROM drawn JOIN kinds USING (s, rank) GROUP BY rep)"""
    + _INTERVAL,
)
def bootstrap_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = audit.flagged(variants(spark, sf_dir)).groupBy("base_id").agg(F.avg("flip").alias("f"))
    return rounded(resample.bootstrap_mean(cases, "f", REPS, SEED), "low", "high")


_SYSTEMS = """SELECT *, CASE WHEN toxic = 1 THEN 'entailment' ELSE gold END AS pred, CASE WHEN doc_id % 7 = 0 THEN 'neutral' WHEN doc_id % 11 = 0 THEN 'entailment' ELSE gold END AS pred2 FROM (SELECT doc_id, lang, source, toxic, CASE WHEN quality = 1 THEN 'entailment' ELSE 'contradiction' END AS gold FROM rated)"""
_JOINT = ("CAST(gold = pred AND doc_id % 2 = 0 AS INT) AS joint", "CAST(gold = pred2 AND doc_id % 3 <> 0 AS INT) AS joint2")


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' predictions of the labelled documents' quality, and whether each is right in all."""
    rows = spark.sql(_SYSTEMS.replace("FROM rated", "FROM {rated}"), rated=rated(spark, sf_dir).select("doc_id", "lang", "source", "quality", "toxic"))
    return rows.selectExpr("doc_id", "lang", "source", "gold", "pred", "pred2", *_JOINT)


def _macro(pred: str) -> str:
    number = lambda c: f"coalesce(sum(n) FILTER ({c}), 0)"
    f1 = (f"coalesce(2.0::DOUBLE * {number(f"gold = '{x}' AND {pred} = '{x}'")} / nullif({number(f"gold = '{x}'")} + {number(f"{pred} = '{x}'")}, 0), 0)" for x in ("entailment", "contradiction", "neutral"))
    return f"({' + '.join(f1)}) / 3"


_SIGNS = "SELECT measure, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg((v > 0)::INT), 6) AS above, round(avg((v < 0)::INT), 6) AS below FROM reps GROUP BY measure"


@registered(
    "bootstrap_paired",
    f"""WITH {_RATED}, systems AS (SELECT *, {', '.join(_JOINT)} FROM ({_SYSTEMS})), {_kinds('systems', 'gold, pred, pred2, joint, joint2')}, {_tree()},
wide AS (SELECT rep, (sum(n * (gold = pred2)::INT) - sum(n * (gold = pred)::INT)) / sum(n) AS accuracy, {_macro('pred2')} - {_macro('pred')} AS macro_f1, (sum(n * joint2) - sum(n * joint)) / sum(n) AS joint FROM drawn JOIN kinds USING (s, rank) GROUP BY rep),
reps AS (SELECT 'accuracy' AS measure, accuracy AS v FROM wide UNION ALL SELECT 'macro_f1', macro_f1 FROM wide UNION ALL SELECT 'joint', joint FROM wide) {_SIGNS}""",
)
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.paired_deltas(systems(spark, sf_dir), REPS, SEED), "low", "high", "above", "below")


@registered(
    "bootstrap_paired_clusters",
    f"""WITH {_RATED}, clusters AS (SELECT sum((gold = pred2)::INT - (gold = pred)::INT)::BIGINT AS s1, count(*) AS s2 FROM ({_SYSTEMS}) GROUP BY lang, source), {_kinds('clusters', 's1, s2')}, {_tree()},
reps AS (SELECT 'accuracy' AS measure, sum(n * s1) / sum(n * s2) AS v FROM drawn JOIN kinds USING (s, rank) GROUP BY rep) {_SIGNS}""",
)
def bootstrap_paired_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.paired_cluster_deltas(systems(spark, sf_dir), ["lang", "source"], REPS, SEED), "low", "high", "above", "below")


@registered(
    "bootstrap_cluster",
    f"""WITH {_RATED}, clusters AS (SELECT sum(quality)::BIGINT AS s1, count(*) AS s2 FROM rated GROUP BY lang, source), {_kinds('clusters', 's1, s2')}, {_tree()},
reps AS (SELECT rep, sum(n * s1) / sum(n * s2) AS v FROM drawn JOIN kinds USING (s, rank) GROUP BY rep)"""
    + _INTERVAL,
)
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.cluster_bootstrap(rated(spark, sf_dir), ["lang", "source"], F.col("quality"), REPS, SEED), "low", "high")


@registered("sequential_interval")
def sequential_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.sequential_bootstrap(rated(spark, sf_dir), "quality", "doc_id", 200, 2026), "low", "high")


@registered("percentiles_linear", "SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS p{i}" for i, q in enumerate((0.025, 0.5, 0.975))) + " FROM orders GROUP BY o_orderpriority")
def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = [F.round(F.percentile("o_totalprice", F.lit(q)), 4).alias(f"p{i}") for i, q in enumerate((0.025, 0.5, 0.975))]
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*measures)


@registered("percentiles_nearest", "SELECT source, list_sort(list(n_chars))[round_even((count(*) - 1) * 0.1, 0)::INT + 1] AS p10, list_sort(list(n_chars))[round_even((count(*) - 1) * 0.5, 0)::INT + 1] AS p50 FROM documents GROUP BY source")
def percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.nearest_ranks(table(spark, sf_dir, "documents"), "n_chars", {"p10": 0.1, "p50": 0.5}, "source")
