"""Span algebra as column arithmetic: inclusive token spans and half-open character spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Tokens that two inclusive spans share; null if a bound is."""
    # greatest and least skip nulls, so a missing bound is asked for first
    some = start1.isNull() | end1.isNull() | start2.isNull() | end2.isNull()
    return F.when(~some, F.greatest(F.lit(0), F.least(end1, end2) - F.greatest(start1, start2) + 1))


def size(start: Column, end: Column) -> Column:
    return end - start + 1


def scores(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """struct(token_f1, iou, exact) of two inclusive spans; a null start is an empty span.

    Two empty spans agree fully, an empty and a filled one not at all.
    """
    none1, none2 = start1.isNull(), start2.isNull()
    both = overlap(start1, end1, start2, end2)
    total = size(start1, end1) + size(start2, end2)
    f1 = F.when(none1 & none2, 1.0).when(none1 | none2, 0.0).otherwise(2 * both / total)
    iou = F.when(none1 & none2, 1.0).when(none1 | none2, 0.0).otherwise(both / (total - both))
    exact = F.when(none1 & none2, True).when(none1 | none2, False).otherwise((start1 == start2) & (end1 == end2))
    return F.struct(f1.alias("token_f1"), iou.alias("iou"), exact.alias("exact"))


def character_scores(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """struct(char_f1, char_exact) of two half-open spans; of length 0 they are empty."""
    n1, n2 = end1 - start1, end2 - start2
    shared = F.greatest(F.lit(0), F.least(end1, end2) - F.greatest(start1, start2))
    f1 = F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0), 0.0).otherwise(2 * shared / F.nullif(n1 + n2, F.lit(0)))
    return F.struct(f1.alias("char_f1"), ((start1 == start2) & (end1 == end2)).alias("char_exact"))


def covering_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """struct(first, last): ids of the first and last token that overlap the half-open span; nulls where none does.

    tokens: array<struct<token_id, text, char_start, char_end>>.
    """
    met = F.filter(tokens, lambda t: (t["char_end"] > start) & (t["char_start"] < end))
    return F.struct(F.try_element_at(met, F.lit(1))["token_id"].alias("first"), F.try_element_at(met, F.lit(-1))["token_id"].alias("last"))


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end): the half-open span without white space at its ends; empty at its end if it has nothing else."""
    part = F.substring(text, start + 1, end - start)
    left = F.length(part) - F.length(F.regexp_replace(part, r"(?U)^[\s\x1c-\x1f]+", ""))
    right = F.length(part) - F.length(F.regexp_replace(part, r"(?U)[\s\x1c-\x1f]+$", ""))
    return F.struct((start + left).alias("start"), F.greatest(start + left, end - right).alias("end"))


def is_sound(text: Column, start: Column, end: Column, covered: Column) -> Column:
    """Whether 0 <= start <= end <= length and the half-open span reads `covered`."""
    inside = (start >= 0) & (start <= end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == covered), F.lit(False))
