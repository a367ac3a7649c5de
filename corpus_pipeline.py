"""From raw documents to token ids: quality, near-duplicates, mixing, encoding.

Every stage works on all rows that the one before it kept, as written to Parquet
and read again. The first three return the columns of documents, and any others that docs has, whatever
their names. All take texts of any length whole, and give an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kappaloom.llm.bpe import encode_documents
from kappaloom.llm.kneser_ney import kept
from kappaloom.llm.mixing import drawn
from kappaloom.llm.shared import staged, table
from kappaloom.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text lies between their language's thresholds.

    Null, empty and blank texts go. Rows with a null id or language are judged like others, the latter by all languages' thresholds.
    Repeated rows stay as often as they came; a text on a threshold stays.
    """
    return kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose SimHash fingerprints differ in three bits at most, or whose five-word similarity is 0.8 or more.

    Of a group the smallest id stays, null ids last, and of rows that share it the first text by hash; repeated rows are one. Null, empty and
    blank texts are copies of each other.
    """
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, with the sources' weights evened out: a document can be drawn more than once or not at all.

    The null source is one of its own. Texts without words have no tokens; sources without tokens are not drawn. Repeated rows
    are drawn each; rows that differ in other columns alone stand for each other.
    """
    return drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: a row for every drawn document, null ids and repeated rows included. A null or blank text has no ids."""
    return encode_documents(docs, outputs=("n_tokens", "ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding", encode),
]

#: Fingerprints, the merge rounds and the model are beyond SQL; the tests have brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
