"""Joins of annotation sets: one to one, missing sides, content keys, shifted partners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.text import WORD
from ..sources.shared import staged
from .order import hash_numbered, indexed


def report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n, first_key): how many keys are on both sides, or on one only."""
    joined = left.select(key, F.lit(1).alias("_l")).join(right.select(key, F.lit(1).alias("_r")), key, "full_outer")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return joined.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


class Misaligned(ValueError):
    """Two sets that should have the same keys: names some of those that are missing on either side."""


def strict(left: DataFrame, right: DataFrame, key: str, told: int = 20) -> DataFrame:
    """Both sides' columns, the right ones with the suffix _2, one row a key in key order; different or repeated keys are an error that names up to `told` of each side."""
    sides = [df.groupBy(key).agg(F.count("*").alias(f"_n{i}")) for i, df in enumerate((left, right))]
    counted = sides[0].join(sides[1], key, "full_outer").na.fill(0, ["_n0", "_n1"]).where("_n0 <> 1 OR _n1 <> 1")
    kind = F.when(F.col("_n1") == 0, "missing on the right").when(F.col("_n0") == 0, "missing on the left").otherwise("repeated")
    first = F.row_number().over(Window.partitionBy("kind").orderBy(key))
    wrong = counted.withColumn("kind", kind).withColumn("_r", first).where(F.col("_r") <= told).orderBy("kind", key).collect()
    if wrong:
        kinds = sorted({r.kind for r in wrong})
        raise Misaligned("; ".join(f"{k}: {', '.join(str(r[key]) for r in wrong if r.kind == k)}" for k in kinds))
    renamed = right.select(key, *[F.col(c).alias(f"{c}_2") for c in right.columns if c != key])
    return left.join(renamed, key).orderBy(key)


def in_order(gold: DataFrame, other: DataFrame, key: str, position: str) -> DataFrame:
    """As strict(), in the order of gold's position."""
    return strict(gold, other, key).orderBy(position)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done, key, "left_anti")


def mentions(docs: DataFrame, names: DataFrame, id_column: str, text: str, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, and the columns to keep): the names, of one word or more, that stand in a text with no letter, digit or underscore beside them; a row for each row of docs and name.

    Texts are cut into words once and meet a name's longest word by equality; names of several words are then looked for as a whole. Names are
    written first, so that a few are broadcast, and texts need not be shuffled with every word of theirs.
    """
    cut = rf"[^{WORD}]+"
    parts = F.filter(F.split(F.col(name), cut), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(parts, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    keyed = staged(names.select(F.col(name).alias("name"), longest.alias("_word"), (F.size(parts) > 1).alias("_several")), "names")
    pattern = F.concat(F.lit(rf"(?<![{WORD}])\Q"), F.col("name"), F.lit(rf"\E(?![{WORD}])"))
    whole = docs.select(F.col(id_column), *keep, F.col(text).alias("_text")).withColumn("_word", F.explode(F.array_distinct(F.split("_text", cut))))
    met = whole.join(keyed, "_word").where(~F.col("_several") | F.regexp_like("_text", pattern))
    return met.select(id_column, "name", *keep)


def by_content(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(key, n, ids): rows of equal content, with all their ids in order; an array is as large as its group, whose members can also be had by join on the key."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_column)).alias("ids"))


def shifted_partners(df: DataFrame, id_column: str, group: str) -> DataFrame:
    """(id, group, partner, partner_group): everyone is given a partner of another group, each row once.

    Rows are numbered in group order and shifted by the size of the largest group,
    which leads out of every group if no group holds more than half of the rows; where one does,
    there is no such pairing, and that is an error. The numbers are built from the groups' sizes, so no task sees all rows.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    starts = sizes.select(group, (F.sum("_n").over(Window.orderBy(group)) - F.col("_n")).alias("_start"))  # one row a group
    whole = sizes.agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    whole = whole.withColumn("_most", F.when(F.col("_most") * 2 <= F.col("_all"), F.col("_most")).otherwise(F.raise_error(F.lit("a group holds more than half of the rows"))))
    inside = hash_numbered(df.select(id_column, group), [group], order_key("pairs", F.col(id_column)), id_column, "_i")
    placed = inside.join(starts, group).join(F.broadcast(whole)).withColumn("_at", F.col("_start") + F.col("_i"))
    partners = placed.select(F.col(id_column).alias("partner"), F.col(group).alias("partner_group"), F.col("_at").alias("_to"))
    return placed.withColumn("_to", F.pmod(F.col("_at") + F.col("_most"), F.col("_all"))).join(partners, "_to").select(id_column, group, "partner", "partner_group")


class Unpaired(ValueError):
    """No pairing that differs in both keys was found."""


def unlike_partners(df: DataFrame, id_column: str, group: str, content: str, seed: int | str = "pairs", rounds: int = 30, asks: int = 8) -> DataFrame:
    """(id, partner): everyone is given a partner of another group and of other content, each row once.

    Rows stand in the order of their groups, and of contents inside, and are shifted by the size of the largest group, so that groups differ. Where contents are equal, partners are
    exchanged with a row at one of the places that hashes tell, if both pairs that arise are sound; a row takes part in one exchange a round. A group or a content of more than
    half of the rows has no pairing, which is an error; so is a pairing that is not found in `rounds`. A null group or content is one of its own.
    """
    base = df.select(F.col(id_column).alias("_id"), F.sha2(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")), 256).alias("_g"), F.sha2(F.coalesce(F.concat(F.lit("="), F.col(content).cast("string")), F.lit("")), 256).alias("_c"))
    rows = staged(indexed(base, ["_g", "_c", "_id"], "_place"), "placed")
    largest = lambda c: rows.groupBy(c).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n, most, same = rows.count(), largest("_g"), largest("_c")
    if 2 * most > n or 2 * same > n:
        raise Unpaired("a group or a content holds more than half of the rows")
    there = rows.select(F.col("_place").alias("_to"), F.col("_g").alias("_pg"), F.col("_c").alias("_pc"), F.col("_id").alias("_partner"))
    pairs = staged(rows.withColumn("_to", F.pmod(F.col("_place") + most, F.lit(max(1, n)))).join(there, "_to"), "pairs")
    alike = (F.col("_g") == F.col("_pg")) | (F.col("_c") == F.col("_pc"))
    for turn in range(rounds + 1):
        bad = staged(pairs.where(alike), "alike")
        if bad.isEmpty():
            return pairs.select(F.col("_id").alias(id_column), F.col("_partner").alias("partner"))
        if turn == rounds:
            break
        # everyone asks at some places and takes the first sound one by hash; of those who take the same row the first by hash has it
        places = F.explode(F.transform(F.sequence(F.lit(1), F.lit(asks)), lambda i: F.pmod(F.xxhash64("_place", i, F.lit(f"{seed}|{turn}")), F.lit(n))))
        asked = bad.select(F.struct(*bad.columns).alias("_b"), places.alias("_ask")).join(bad.select(F.col("_place").alias("_ask")), "_ask", "left_anti")
        met = asked.join(pairs.select(F.col("_place").alias("_ask"), F.struct(*pairs.columns).alias("_o")), "_ask")
        sound = (F.col("_b._g") != F.col("_o._pg")) & (F.col("_b._c") != F.col("_o._pc")) & (F.col("_o._g") != F.col("_b._pg")) & (F.col("_o._c") != F.col("_b._pc"))
        first = F.xxhash64("_b._place", "_ask")
        taken = met.where(sound).groupBy("_b").agg(F.min_by("_o", first).alias("_o"))
        won = taken.groupBy("_o").agg(F.min_by("_b", F.xxhash64("_b._place")).alias("_b"))
        ends = ["_to", "_pg", "_pc", "_partner"]
        swap = lambda a, b: F.struct(F.col(f"{a}._place").alias("_row"), *[F.col(f"{b}.{c}").alias(f"{c}_new") for c in ends])
        moved = won.select(F.explode(F.array(swap("_b", "_o"), swap("_o", "_b"))).alias("_m")).select("_m.*")
        kept = pairs.join(moved, F.col("_place") == F.col("_row"), "left").select(*[c for c in pairs.columns if c not in ends], *[F.when(F.col("_row").isNull(), F.col(c)).otherwise(F.col(f"{c}_new")).alias(c) for c in ends])
        pairs = staged(kept.select(*pairs.columns), "pairs")
    raise Unpaired(f"{bad.count()} rows have a partner like them after {rounds} rounds")
