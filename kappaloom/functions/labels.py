"""Labels: their fixed order, aliases, distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label set in its order, which also breaks ties.
LABELS = ("entailment", "contradiction", "neutral")
# Other names of the labels.
ALIASES = {"entails": "entailment", "implication": "entailment", "contradict": "contradiction", "neutre": "neutral"}
NEUTRAL = "neutral"


def normalised(label: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Trimmed, lower-cased, aliases resolved; an unknown label passes through."""
    plain = F.lower(F.trim(label))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), plain)


def most_probable(probabilities: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label of the first largest probability; probabilities is an array in the labels' order."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def total_variation(p: Column, q: Column) -> Column:
    """Half the sum of absolute differences of two distributions."""
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) * 0.5


def softmax(logits: Column) -> Column:
    """Exponentials of the logits, shifted by their maximum, divided by their sum."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def probability_map(probabilities: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """map<label, probability> of an array in the labels' order."""
    return F.map_from_arrays(F.array(*map(F.lit, labels)), probabilities)


def next_id(ids: Column, prefix: str, width: int) -> Column:
    """An aggregate: the id after the largest of those with this prefix, from 1."""
    number = F.when(ids.startswith(prefix), F.regexp_extract(ids, r"^[^-]*-(\d+)", 1).try_cast("long"))
    return F.concat(F.lit(prefix), _padded(F.coalesce(F.max(number), F.lit(0)) + 1, width))


def _padded(number: Column, width: int) -> Column:
    """The digits with zeros before them; longer ones are not cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def looked_up_id(asked: Column, prefix: str, width: int) -> Column:
    """The id that a person's entry stands for: itself in capitals if it has the prefix in any case, the number with the prefix if it is one; null if blank, else as it is."""
    text = F.trim(asked)
    number = F.when(text.rlike(r"^\d+$"), F.concat(F.lit(prefix), _padded(text.try_cast("long"), width)))
    return F.when(text == "", None).when(F.upper(text).startswith(prefix), F.upper(text)).otherwise(F.coalesce(number, text))


def record_id(*candidates: Column, position: Column) -> Column:
    """The first id that is not blank, else the row's place."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates], F.concat(F.lit("row-"), position.cast("string")))
