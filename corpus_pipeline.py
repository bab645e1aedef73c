"""A corpus from raw documents to packed sequences, stage by stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of documents, the last one the packed pieces. Each stage works on
all that its predecessor kept: toxic documents go; lines that many documents share stay in one
of them; of near-equal documents one stays; runs of words seen earlier are cut out of texts;
and what is left is packed.

Every stage bears nulls in any column, empty and very long texts, repeated rows, empty tables and
further columns with any names: a row whose text is null, empty or blank is never dropped by
the stages before the last and counts there as one end-of-text id; rows that repeat a doc_id
are rows of their own until near_dedup, which keeps one of equal texts with words; an empty table
stays empty. Columns other than text (and n_chars, counted anew) are never changed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonalpanel.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from zonalpanel.llm.common import settled, table
from zonalpanel.session import prepare

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones, does not call toxic.

    A text without features (null, empty) has the score of the constant alone. Without labels of
    both classes that constant decides for all, and stays under the limit unless most are toxic.
    """
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more hold, but for the last of these.

    Null doc_ids count as one document that keeps no shared line; null texts stay null.
    """
    prepare(spark)
    return line_dedup.without_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of equal rows one, of texts without words all."""
    prepare(spark)
    return near_dedup.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of twenty words or more that begin earlier elsewhere; shorter texts stay as they are."""
    prepare(spark)
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens; a null or empty text is one piece of one id."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: SQL can't express the classifier, the sampling or the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
