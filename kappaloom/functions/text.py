"""Text functions: tokens with offsets, rendering, keys, whole-word search and replacement."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's white space in Java's syntax; the four separators are no white space to Java.
SPACE = r"\s\x1c-\x1f"
#: What a whole word has none of beside it: letters, digits and underscores of any script, in Java's syntax.
WORD = r"\p{L}\p{N}_"
#: Every code point that is white space lies below this one.
BEYOND_SPACE = 0x3001
_IS_SPACE = np.array([chr(i).isspace() for i in range(BEYOND_SPACE)])


#: Types are spelled out, since a type's name is read by a session, which there may not be yet.
TOKENS = T.ArrayType(T.StructType([T.StructField("token_id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]))


#: Code points of texts that are laid out at once, about.
LAID_OUT = 1 << 20


def token_lists(texts: pa.Array) -> pa.Array:
    """The tokens of a column of texts as one flat array of structs and its offsets.

    Texts are taken in runs of some LAID_OUT code points, or one longer text, so that a batch of many long ones needs little memory besides its tokens.
    """
    upto = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LAID_OUT, "right")))
        parts.append(_token_lists(texts.slice(at, end - at)))
        at = end
    return pa.concat_arrays(parts) if parts else _token_lists(texts)


def _token_lists(texts: pa.Array) -> pa.Array:
    """token_lists() of few texts.

    All texts are laid out as one row of code points, a space behind each. Where white space ends or begins, a token
    begins or ends; what is left without the white space is the tokens' bytes.
    """
    texts = pc.fill_null(texts, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(" ".join([*texts.to_pylist(), ""]).encode("utf-32-le"), np.uint32)
    space = _IS_SPACE[np.minimum(points, BEYOND_SPACE - 1)] & (points < BEYOND_SPACE)
    turns = np.flatnonzero(np.diff(np.r_[True, space, True]))
    starts, ends = turns[::2], turns[1::2]
    rows = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(rows, starts, "right") - 1
    first = np.searchsorted(starts, np.r_[rows, len(points)])
    left = points[~space]
    bytes_of = 1 + (left > 0x7F) + (left > 0x7FF) + (left > 0xFFFF)
    upto = np.r_[0, np.cumsum(bytes_of)][np.r_[0, np.cumsum(ends - starts)]]
    data = left.tobytes().decode("utf-32-le").encode()
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data)])
    numbers = np.arange(len(starts)) - first[owner] + 1
    fields = [pa.array(numbers, pa.int32()), words, pa.array(starts - rows[owner], pa.int32()), pa.array(ends - rows[owner], pa.int32())]
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(fields, TOKENS.elementType.names))


@F.arrow_udf(TOKENS)
def tokens(texts: pa.Array) -> pa.Array:
    """Maximal runs of other than white space: ids from 1, half-open offsets in code points."""
    return token_lists(texts)


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token_id, text, char_start, char_end), a row a token. A text's tokens come out of one batch: nothing is shuffled or sorted."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("t")).select(key, "t.*")


def token_span(text: Column, start: Column, end: Column) -> Column:
    """struct(first, last): ids of the tokens that overlap the half-open character span, nulls if none does.

    Only tokens of the text before the span's start and end are counted.
    """
    before = F.size(words(F.substring(text, F.lit(1), start)))
    inside = lambda at: F.substring(text, at, F.lit(1)).rlike(rf"(?U)^[^{SPACE}]")
    cut = (start > 0) & inside(start) & inside(start + 1)
    first, last = before + F.when(cut, 0).otherwise(1), F.size(words(F.substring(text, F.lit(1), end)))
    some = (start < end) & (first <= last)
    return F.struct(F.when(some, first).alias("first"), F.when(some, last).alias("last"))


def words(text: Column) -> Column:
    """The tokens' texts alone."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?U)[^{SPACE}]+"), F.lit(0))


def numbered(texts: Column) -> Column:
    """One line for each token: its number in brackets, a space, its text."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), i + 1, F.lit("] "), t)), "\n")


def numbers(rendered: Column) -> Column:
    """The numbers of a rendering, null unless they count from 1 without a gap."""
    found = F.transform(F.regexp_extract_all(rendered, F.lit(r"(?m)^\[(\d+)\] "), F.lit(1)), lambda x: x.cast("int"))
    return F.when(found == F.when(F.size(found) > 0, F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)))).otherwise(F.expr("CAST(array() AS array<int>)")), found)


def span_text(texts: Column, first: Column, last: Column) -> Column:
    """Tokens first to last, from 1 and inclusive, joined by spaces; null if a bound is."""
    return F.array_join(F.slice(texts, first, last - first + 1), " ")


def collapsed(text: Column) -> Column:
    """White space trimmed and every run of it made one space."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def folded(text: Column) -> Column:
    return F.lower(collapsed(text))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed normal form; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """Compatible normal form, case folded (unlike lower(), ß is ss), white space collapsed."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def _bordered(word: str) -> str:
    return rf"(?<![{WORD}]){re.escape(word)}(?![{WORD}])"


def has_word(text: Column, word: str) -> Column:
    """Whether the word stands in the text with no letter, digit or underscore beside it."""
    return text.rlike(_bordered(word))


def replace_word(text: Column, word: str, by: str) -> Column:
    """The text with every whole word replaced, null if there is none to replace."""
    return F.when(has_word(text, word), F.regexp_replace(text, _bordered(word), by.replace("\\", "\\\\").replace("$", "\\$")))


def mentions(text: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text contains any phrase."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.lower(text).contains(phrase.lower())
    return F.coalesce(found, F.lit(False))
