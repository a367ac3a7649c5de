"""Content hashes, and draws that are a hash of seed, replicate and number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(*parts: Column | str | int) -> Column:
    """Parts as text with bars between them; strings are literals."""
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def order_key(seed: int | str, *parts: Column | str | int) -> Column:
    """A hexadecimal SHA-256 to order by."""
    return F.sha2(joined(seed, *parts), 256)


def draw(n: Column, seed: int | str, *parts: Column | str | int) -> Column:
    """A number from 0 to n - 1, the same in every engine that has SHA-256."""
    return F.pmod(F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("long"), n)


def uniform(seed: int | str, *parts: Column | str | int) -> Column:
    """A number from 0 to below 1 with 52 bits, the same in every engine that has SHA-256."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def request_id(premise: Column, hypothesis: Column) -> Column:
    return F.sha2(F.concat_ws("\n", premise, hypothesis), 256)


def fingerprint(df: DataFrame, record: Column, *keys: str, digits: int = 3) -> DataFrame:
    """(keys, n, fingerprint): the same whatever the order of rows.

    Hashes of records are sorted and hashed in buckets of their first hexadecimal digits,
    and the buckets' hashes again, so that no task sorts all records.
    """
    hashed = df.select(*keys, F.sha2(record, 256).alias("_h")).withColumn("_b", F.substring("_h", 1, digits))
    joined_list = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    buckets = hashed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), joined_list("_h").alias("_f"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_f"))), lambda x: x["_f"])
    return buckets.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(whole, "\n"), 256).alias("fingerprint"))
