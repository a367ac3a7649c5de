"""Groups of rows that share keys, and their division into splits."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.numeric import largest_remainder
from ..sources.shared import staged
from .components import connected
from .order import hash_numbered


def grouped(df: DataFrame, id_column: str, keys: dict[str, Column]) -> DataFrame:
    """(id, group): rows that share a key, directly or through others, have one group, named by its least id.

    keys: the kinds of keys; null keys link nothing. Every row is linked to the
    least row of each of its keys, so a key of n rows makes n links and no pairs.
    """
    kinds = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}|"), c)) for name, c in keys.items()]))
    keyed = df.select(id_column, F.explode(kinds).alias("_key")).select(id_column, F.sha2("_key", 256).alias("_key"))
    least = keyed.groupBy("_key").agg(F.min(id_column).alias("_least"))
    links = keyed.join(least, "_key").select(F.col(id_column).alias("a"), F.col("_least").alias("b")).where("a <> b").distinct()
    found = connected(links).select(F.col("node").alias(id_column), F.col("component").alias("group"))
    return df.select(id_column).distinct().join(found, id_column, "left").withColumn("group", F.coalesce("group", id_column))


def constraint_faults(members: DataFrame, keyed: DataFrame, id_column: str) -> DataFrame:
    """(check, faults): ids in more than one group, ids in none, keys that stand in more than one group.

    members (id, group), keyed (id, key).
    """
    many = members.groupBy(id_column).agg(F.count_distinct("group").alias("n")).agg(F.count_if(F.col("n") > 1).alias("f"))
    none = keyed.select(id_column).distinct().join(members, id_column, "left_anti").agg(F.count("*").alias("f"))
    keys = keyed.join(members, id_column).groupBy("key").agg(F.count_distinct("group").alias("n")).agg(F.count_if(F.col("n") > 1).alias("f"))
    named = lambda x, df: df.select(F.lit(x).alias("check"), F.col("f").alias("faults"))
    return named("exclusive", many).unionByName(named("covered", none)).unionByName(named("one_group_a_key", keys))


def split_targets(df: DataFrame, label: str, ratios: tuple[tuple[str, int], ...] = (("train", 70), ("validation", 15), ("test", 15))) -> DataFrame:
    """(label, split, target): each label's rows shared out by per cent, whole numbers by largest remainder."""
    counts = df.groupBy(label).agg(F.count("*").alias("total"))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("split"), F.lit(r).alias("num"), F.lit(100).alias("den")) for i, (name, r) in enumerate(ratios)])).alias("p")
    rows = counts.select(label, "total", parts).select(label, "total", "p.*")
    return largest_remainder(rows, [label], "total", "share", ("num", "den"), "i").select(label, "split", F.col("share").alias("target"))


def assign_splits(members: DataFrame, targets: DataFrame, label: str, restarts: int = 16, swaps: int = 2000, seed: int = 2026) -> DataFrame:
    """(group, split): whole groups to splits, near the targets of each label.

    Groups are reduced to their label counts; alike ones are one kind with a number, so
    that what a restart holds, and its steps, are bounded by the kinds, not the groups. Restarts run in
    parallel and deal kinds, largest first, to the split that lacks most, with random ties and
    then random swaps; the least deviation wins, then the first restart. Groups
    of a kind are taken in hash order.
    """
    spark = members.sparkSession
    names = [r[0] for r in targets.select("split").distinct().orderBy("split").collect()]
    labels = [r[0] for r in targets.select(label).distinct().orderBy(label).collect()]
    shape = members.groupBy("group").pivot(label, labels).agg(F.count(F.lit(1))).na.fill(0, labels)
    shape = shape.withColumn("kind", F.concat_ws(",", *[F.col(x).cast("string") for x in labels]))
    kinds = [(r.kind, r.n) for r in shape.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()]
    aims = {(r[label], r["split"]): r["target"] for r in targets.collect()}
    want = [[aims.get((x, s), 0) for x in labels] for s in names]
    shares, few = [sum(w) / max(1, sum(map(sum, want))) for w in want], 4 * len(names)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = [tuple(map(int, k.split(","))) for k, _ in kinds]
        for part in parts:
            for run in part["id"]:
                rng = random.Random(seed * 1009 + int(run))
                have = [[0] * len(labels) for _ in names]
                dealt = [[0] * len(names) for _ in kinds]

                def lack(s: int, size: tuple[int, ...], have: list = have) -> float:
                    return sum((want[s][j] - have[s][j]) * size[j] / (want[s][j] + 1) for j in range(len(size)))

                def move(k: int, a: int | None, b: int, times: int = 1, have: list = have, dealt: list = dealt) -> None:
                    for j, x in enumerate(sizes[k]):
                        have[b][j] += x * times
                        if a is not None:
                            have[a][j] -= x * times
                    dealt[k][b] += times
                    if a is not None:
                        dealt[k][a] -= times

                def off(have: list = have) -> int:
                    return sum(abs(h - w) for hs, ws in zip(have, want, strict=True) for h, w in zip(hs, ws, strict=True))

                for k in sorted(range(len(kinds)), key=lambda k: (-sum(sizes[k]), rng.random())):
                    # of many groups of a kind, each split takes its share at once; a few are dealt one by one
                    at_once = [int(shares[s] * max(0, kinds[k][1] - few)) for s in range(len(names))]
                    for s, times in enumerate(at_once):
                        move(k, None, s, times)
                    for _ in range(kinds[k][1] - sum(at_once)):
                        move(k, None, max(range(len(names)), key=lambda s: (lack(s, sizes[k]), rng.random())))
                now = off()
                for _ in range(swaps if len(names) > 1 else 0):
                    k = rng.randrange(len(kinds))
                    a, b = rng.sample(range(len(names)), 2)
                    if dealt[k][a]:
                        move(k, a, b)
                        if (new := off()) <= now:
                            now = new
                        else:
                            move(k, b, a)
                yield pd.DataFrame({"run": [run], "off": [now], "dealt": [[x for row in dealt for x in row]]})

    best = spark.range(restarts).repartition(restarts).mapInPandas(search, "run long, off long, dealt array<long>").orderBy("off", "run").first()
    width = len(names)
    bounds = []
    for k, (kind, _) in enumerate(kinds):
        at = 0
        for s in range(width):
            n = best.dealt[k * width + s] if best else 0
            bounds.append((kind, names[s], at, at + n))
            at += n
    plan = spark.createDataFrame(bounds or [("", "", 0, 0)], "kind string, split string, low long, high long")
    ranked = hash_numbered(shape.select("group", "kind"), ["kind"], order_key(seed, F.col("group")), "group", "i")
    return ranked.join(plan, "kind").where("i >= low AND i < high").select("group", "split")


def folds(members: DataFrame, n: int, seed: int | str, label: str | None = None) -> DataFrame:
    """(group, fold): whole groups to folds of nearly equal rows and, with a label column, of nearly equal labels.

    Groups are laid out largest first and, among equals, by their counts of labels, and dealt forth and back: those that are alike
    stand together and so spread over all folds. Their numbers are built from the kinds' sizes, and inside a kind by hash.
    """
    if label is None:
        shape = members.groupBy("group").agg(F.count("*").alias("size"), F.lit("").alias("kind"))
    else:
        per = members.groupBy("group", label).agg(F.count("*").alias("c")).withColumn("c", F.concat_ws(":", F.col(label).cast("string"), F.col("c").cast("string")))
        shape = members.groupBy("group").agg(F.count("*").alias("size")).join(per.groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("kind")), "group")
    of_kind = shape.groupBy("size", "kind").agg(F.count("*").alias("c"))
    starts = of_kind.select("size", "kind", (F.sum("c").over(Window.orderBy(F.desc("size"), "kind")) - F.col("c")).alias("start"))  # one row a kind
    inside = hash_numbered(shape, ["size", "kind"], order_key(seed, F.col("group")), "group", "i")
    at = inside.join(starts, ["size", "kind"]).withColumn("at", F.col("start") + F.col("i"))
    there = F.pmod("at", F.lit(n))
    return at.select("group", F.when(F.pmod(F.floor(F.col("at") / n), F.lit(2)) == 0, there).otherwise(n - 1 - there).cast("long").alias("fold"))


def nested_folds(members: DataFrame, outer: int, inner: int, seed: int | str, label: str) -> DataFrame:
    """(group, fold, held, inner_fold): for every outer fold that is held out, the inner fold of each other group."""
    outside = staged(folds(members, outer, seed, label), "outer-folds")
    out = None
    for k in range(outer):
        rest = members.join(outside.where(F.col("fold") != k).select("group"), "group")
        part = folds(rest, inner, f"{seed}|{k}", label).withColumnRenamed("fold", "inner_fold").withColumn("held", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return outside.join(out, "group").select("group", "fold", "held", "inner_fold")


def one_row_a_key(df: DataFrame, id_column: str, key: str, label: str, target: int, seed: int | str) -> DataFrame:
    """Up to `target` rows of each label, no key twice: (id, key, label).

    A maximum flow from labels to keys, over the counts of keys by the set of labels
    they offer (a few sets, however many keys), decides how many keys of a set serve which label.
    """
    offers = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("offer"))
    counts = {r.offer: r.n for r in offers.groupBy("offer").agg(F.count("*").alias("n")).collect()}
    labels = sorted({x for o in counts for x in o.split(",")})
    sets = sorted(counts)
    flow = _max_flow(labels, sets, counts, target)
    bounds = []
    for o in sets:
        at = 0
        for x in labels:
            if n := flow.get((x, o), 0):
                bounds.append((o, x, at, at + n))
                at += n
    plan = df.sparkSession.createDataFrame(bounds or [("", "", 0, 0)], f"offer string, {label} string, low long, high long")
    ranked = hash_numbered(offers, ["offer"], order_key(seed, F.col(key)), key, "i")
    chosen = ranked.join(plan, "offer").where("i >= low AND i < high").select(key, label)
    # the least by hash, by partial aggregates: a key may have very many rows
    return df.join(chosen, [key, label]).groupBy(key, label).agg(F.min(F.struct(order_key(seed, F.col(id_column)).alias("h"), F.col(id_column).alias("id")))["id"].alias(id_column)).select(id_column, key, label)


def _max_flow(labels: list[str], sets: list[str], counts: dict[str, int], target: int) -> dict[tuple[str, str], int]:
    """Flow from each label (at most target) to each set that offers it (at most its keys), by augmenting along shortest paths."""
    flow = {(x, o): 0 for o in sets for x in o.split(",")}
    used_label, used_set = dict.fromkeys(labels, 0), dict.fromkeys(sets, 0)
    while True:
        # breadth first from labels with room; back over flow that can be given up
        parent: dict[tuple[str, str], tuple[str, str] | None] = {("label", x): None for x in labels if used_label[x] < target}
        queue, end = list(parent), None
        while queue and end is None:
            kind, name = queue.pop(0)
            if kind == "label":
                steps = [("set", o) for o in sets if (name, o) in flow]
            else:
                if used_set[name] < counts[name]:
                    end = (kind, name)
                    break
                steps = [("label", x) for x in labels if flow.get((x, name), 0) > 0]
            for s in steps:
                if s not in parent:
                    parent[s] = (kind, name)
                    queue.append(s)
        if end is None:
            return flow
        path = [end]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        path.reverse()
        room = min([target - used_label[path[0][1]], counts[end[1]] - used_set[end[1]], *[flow[b[1], a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "set"]])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "label":
                flow[a[1], b[1]] += room
            else:
                flow[b[1], a[1]] -= room
        used_label[path[0][1]] += room
        used_set[end[1]] += room
