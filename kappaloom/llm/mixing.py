"""Mixing sources to target weights: temperature, bisection, block permutations. DataFrame and SQL functions only.

The token shares of the sources are raised to an exponent and normalised. The
exponent is bisected, in one row that holds the distinct shares and how many sources have each, until the
weights' entropy meets a target, or, where a source would be repeated more often
than allowed, until the most repeated source meets that limit. Each source gets its
weight's part of the budget: whole passes over its documents, and part of one
more.

A pass is a permutation: documents are dealt to blocks by a hash, blocks are ordered
by a hash of the pass, and so are the documents in a block. Running totals are
taken over the first digits of the blocks' hashes, over the blocks that share them, and then inside single blocks, so that a source that
holds much of the corpus is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Tokens a block should hold.
BLOCK_TOKENS = 200_000
ENTROPY, REPEATS = 0.97, 4.0


def counted(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(doc_id, source, src, print, n_tokens): tokens are runs of other than ASCII white space; src stands for source and is never null, print for the text."""
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("")).alias("src"),
        F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("print"),
        F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )


def source_plan(tokens: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a source that has tokens: src, total, exponent, weight, quota, passes (whole ones), rest, blocks.

    budget: tokens in all, by default as many as there are. entropy: the target as a
    share of the entropy of equal weights; the exponent lies between 0 and 1, and is 1
    where the sources are more even than that already. repeats: the quota of no source exceeds so many
    times its tokens, as far as an exponent can bring that about.
    """
    totals = staged(tokens.groupBy("src").agg(F.sum("n_tokens").alias("total")).where("total > 0"), "mix-totals")
    row = totals.groupBy("total").agg(F.count("*").alias("k")).agg(F.sort_array(F.collect_list(F.struct("total", "k"))).alias("s"), F.sum(F.expr("total * k")).alias("all"), F.sum("k").alias("sources"))
    row = row.withColumn("budget", F.lit(budget).cast("long") if budget is not None else F.col("all"))
    z = "aggregate(s, 0D, (t, x) -> t + x.k * pow(x.total / `all`, {e}))"
    # entropy of w = p^e / z is ln z - e * sum(w ln p); it falls as e rises, and so does the repetition
    spread = f"ln({z}) - {{e}} * aggregate(s, 0D, (t, x) -> t + x.k * pow(x.total / `all`, {{e}}) * ln(x.total / `all`)) / {z}"
    most = f"aggregate(s, 0D, (t, x) -> greatest(t, pow(x.total / `all`, {{e}}) / x.total)) * budget / {z}"
    bisect = "aggregate(sequence(1, 50), named_struct('lo', 0D, 'hi', 1D), (b, i) -> IF({too_low}, named_struct('lo', (b.lo + b.hi) / 2, 'hi', b.hi), named_struct('lo', b.lo, 'hi', (b.lo + b.hi) / 2)), b -> (b.lo + b.hi) / 2)"
    mid = "((b.lo + b.hi) / 2)"
    # the largest exponent whose entropy reaches the target; at least the smallest that keeps the limit
    by_entropy = bisect.format(too_low=f"({spread.format(e=mid)}) >= {entropy} * ln(sources)") if entropy is not None else "0D"
    by_repeats = bisect.format(too_low=f"({most.format(e=mid)}) > {repeats}") if repeats is not None else "0D"
    row = row.withColumn("exponent", F.expr(f"round(greatest({by_entropy}, {by_repeats}), 9)"))
    row = row.withColumn("z", F.expr(z.format(e="exponent"))).select("exponent", "z", "all", "budget")
    plan = totals.join(F.broadcast(row))  # one row
    plan = plan.selectExpr("src", "total", "exponent", "round(pow(total / `all`, exponent) / z, 9) AS weight", "budget")
    plan = plan.selectExpr("src", "total", "exponent", "weight", "CAST(round(budget * weight) AS bigint) AS quota")
    return plan.selectExpr("*", "quota DIV total AS passes", "quota % total AS rest", f"CAST(ceil(total / {block_tokens}D) AS bigint) AS blocks")


def mixture(docs: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, seed: str = "mix", id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for every time a document is drawn: doc_id, source, n_tokens, pass, slot, place, weight, exponent.

    pass counts from 0, slot is the block's place in the pass and place the document's
    in the block: their order is the permutation. A document is drawn in a last, partial
    pass if the tokens before it are fewer than that pass's rest. A null source is a
    source of its own; a null text has no tokens; sources without tokens have no weight
    and are not drawn. Repeated rows are drawn as such; they and other ties of id and length, which agree in all columns that come out, are in any order. A text of any
    length is counted whole and drawn whole. An empty table gives an empty result. Other columns, whatever their names, are left out.
    """
    return _placed(docs, budget, entropy, repeats, seed, id_column, source_column, text_column, block_tokens).select("doc_id", "source", "n_tokens", "pass", "slot", "place", "weight", "exponent")


def drawn(docs: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, seed: str = "mix", id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs, each as often as mixture() draws it, with the columns of docs, whatever their names.

    Rows that agree in id, source and text stand for each other: of those that differ in other columns, the one of the least hash is drawn as often as all of them.
    """
    times = _placed(docs, budget, entropy, repeats, seed, id_column, source_column, text_column, block_tokens).groupBy("doc_id", "src", "print").agg(F.count("*").alias("times"))
    # all columns of a row in one struct, so that none can clash with ours
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_column).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("")).alias("of"),
        F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("text"),
    )
    single = keyed.groupBy("id", "of", "text").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    joined = single.join(times, F.expr("id <=> doc_id AND of = src AND text = print"))
    return joined.select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")


def _placed(docs: DataFrame, budget: int | None, entropy: float | None, repeats: float | None, seed: str, id_column: str, source_column: str, text_column: str, block_tokens: int) -> DataFrame:
    tokens = staged(counted(docs, id_column, source_column, text_column), "mix-tokens")
    plan = staged(source_plan(tokens, budget, entropy, repeats, block_tokens=block_tokens), "mix-plan")
    # rows of one id, however many, are dealt by their length too
    number = "CAST(conv(substr(sha2(concat_ws('|', '{seed}', src, CAST(doc_id AS string), CAST(n_tokens AS string)), 256), 1, 8), 16, 10) AS bigint)".format(seed=seed)
    dealt = tokens.join(plan.select("src", "blocks"), "src").selectExpr("doc_id", "source", "src", "print", "n_tokens", f"{number} % blocks AS block")
    blocks = dealt.groupBy("src", "block").agg(F.sum("n_tokens").alias("block_tokens")).join(plan, "src")
    turns = blocks.withColumn("pass", F.explode(F.expr("sequence(0L, passes)"))).where("pass < passes OR rest > 0")
    shuffled = f"sha2(concat_ws('|', '{seed}', src, CAST(pass AS string), CAST(block AS string)), 256)"
    turns = staged(turns.withColumn("h", F.expr(shuffled)).selectExpr("*", "substr(h, 1, 3) AS part"), "mix-turns")
    # the parts of a pass are as many as three digits tell apart, and so are numbered first
    parts = turns.groupBy("src", "pass", "part").agg(F.count("*").alias("k"), F.sum("block_tokens").alias("t"))
    ahead = "OVER (PARTITION BY src, pass ORDER BY part ROWS UNBOUNDED PRECEDING)"
    parts = parts.selectExpr("src", "pass", "part", f"sum(k) {ahead} - k AS k", f"sum(t) {ahead} - t AS t")
    over = "OVER (PARTITION BY src, pass, part ORDER BY h, block ROWS UNBOUNDED PRECEDING)"
    turns = turns.join(parts, ["src", "pass", "part"]).selectExpr("src", "block", "pass", "passes", "rest", "weight", "exponent", f"CAST(k + row_number() {over} AS bigint) - 1 AS slot", f"t + sum(block_tokens) {over} - block_tokens AS before")
    turns = turns.where("pass < passes OR before < rest")
    drawn = dealt.join(turns, ["src", "block"])
    inside = f"PARTITION BY src, block, pass ORDER BY sha2(concat_ws('|', '{seed}', CAST(pass AS string), CAST(doc_id AS string)), 256), doc_id, n_tokens"
    placed = drawn.selectExpr("*", f"CAST(row_number() OVER ({inside}) AS bigint) - 1 AS place", f"before + sum(n_tokens) OVER ({inside} ROWS UNBOUNDED PRECEDING) - n_tokens AS begun")
    return placed.where("pass < passes OR begun < rest")


#: What mixture() returns with its defaults, in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE tokens AS MATERIALIZED (
  SELECT doc_id, source, coalesce('=' || source, '') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents
), totals AS MATERIALIZED (
  SELECT src, sum(n_tokens)::BIGINT AS total FROM tokens GROUP BY src HAVING sum(n_tokens) > 0
), shares AS MATERIALIZED (
  SELECT src, total, total::DOUBLE / (SELECT sum(total) FROM totals) AS p, (SELECT sum(total) FROM totals)::BIGINT AS budget, (SELECT count(*) FROM totals) AS n FROM totals
), bisect(i, e_lo, e_hi, r_lo, r_hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN h.high THEN (e_lo + e_hi) / 2 ELSE e_lo END, CASE WHEN h.high THEN e_hi ELSE (e_lo + e_hi) / 2 END,
    CASE WHEN r.much THEN (r_lo + r_hi) / 2 ELSE r_lo END, CASE WHEN r.much THEN r_hi ELSE (r_lo + r_hi) / 2 END
  FROM bisect,
    LATERAL (SELECT ln(sum(pow(p, (e_lo + e_hi) / 2))) - (e_lo + e_hi) / 2 * sum(pow(p, (e_lo + e_hi) / 2) * ln(p)) / sum(pow(p, (e_lo + e_hi) / 2)) >= 0.97 * ln(max(n)) AS high FROM shares) h,
    LATERAL (SELECT max(pow(p, (r_lo + r_hi) / 2) / total) * max(budget) / sum(pow(p, (r_lo + r_hi) / 2)) > 4.0 AS much FROM shares) r
  WHERE i < 50
), exponents AS MATERIALIZED (
  SELECT round(greatest((e_lo + e_hi) / 2, (r_lo + r_hi) / 2), 9) AS exponent FROM bisect WHERE i = 50
), weighted AS (
  SELECT src, total, exponent, round(pow(p, exponent) / sum(pow(p, exponent)) OVER (), 9) AS weight, budget FROM shares, exponents
), plan AS MATERIALIZED (
  SELECT src, exponent, weight, round(budget * weight)::BIGINT // total AS passes, round(budget * weight)::BIGINT % total AS rest, ceil(total / 200000.0)::BIGINT AS blocks FROM weighted
), dealt AS MATERIALIZED (
  SELECT doc_id, source, src, n_tokens, ('0x' || substr(sha256('mix|' || src || '|' || doc_id::VARCHAR || '|' || n_tokens::VARCHAR), 1, 8))::BIGINT % blocks AS block FROM tokens JOIN plan USING (src)
), turns AS (
  SELECT b.src, block, pass, passes, rest, weight, exponent, block_tokens
  FROM (SELECT src, block, sum(n_tokens)::BIGINT AS block_tokens FROM dealt GROUP BY ALL) b JOIN plan USING (src), LATERAL (SELECT unnest(range(passes + 1)) AS pass) x
  WHERE pass < passes OR rest > 0
), ordered AS (
  SELECT *, row_number() OVER w - 1 AS slot, (sum(block_tokens) OVER w - block_tokens)::BIGINT AS before
  FROM turns WINDOW w AS (PARTITION BY src, pass ORDER BY sha256('mix|' || src || '|' || pass::VARCHAR || '|' || block::VARCHAR), block ROWS UNBOUNDED PRECEDING)
), placed AS (
  SELECT d.*, pass, passes, rest, slot, weight, exponent, row_number() OVER w - 1 AS place, before + sum(n_tokens) OVER w - n_tokens AS begun
  FROM dealt d JOIN ordered o ON d.src = o.src AND d.block = o.block AND (pass < passes OR before < rest)
  WINDOW w AS (PARTITION BY d.src, d.block, pass ORDER BY sha256('mix|' || pass::VARCHAR || '|' || doc_id::VARCHAR), doc_id, n_tokens ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, source, n_tokens, pass, slot, place, weight, exponent FROM placed WHERE pass < passes OR begun < rest
"""
