"""A training-data pipeline over ``documents``: five stages, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents`` (and others given, whatever their names). Every stage takes nulls in any column,
empty and very long texts, ties, repeated rows and empty tables; what it makes of them is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard, language, secrets
from tidemark.session import cut, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is learnt from their own labels.

    Texts that are null, empty or without a letter go, and those of which no language has 0.3 of the
    letters; ties go to the language first by name. Rows without ``lang`` are judged like others. If
    no row has a language all go. Repeated rows are judged alike; an empty table stays empty.
    """
    return language.confident(docs, language.learn(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies: five words, 0.8.

    Rows without a word or without a doc_id stay; of rows of one doc_id that are first of their
    groups one stays. Texts of fewer than five words are alike only if equal.
    """
    return jaccard.first_of_each(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that benchmark items share.

    A document that loses all its words goes; one that had none stays, as do null texts. ``n_chars``
    follows the text. Repeated rows are treated alike; without a benchmark all stays as it is.
    """
    return decontaminate.without_spans(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; no row goes.

    Null and empty texts stay; ``n_chars`` follows the text. Repeated rows are masked alike.
    """
    return secrets.masked(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and of what they decode to, a row for each document.

    Null texts count as empty: no token, and the hashes of nothing.
    """
    return bpe.digest(docs, bpe.production_ranks())


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", redacted),
    ("byte_bpe", tokenised),
]

#: Language identification and the secret models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one kept is checkpointed before the next reads it again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
