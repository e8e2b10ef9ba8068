"""A corpus pipeline of five stages over `documents`, each one of the operators in tilewright.llm.

toxicity -> exact_dedup -> ngram_join -> mixing -> packing. A stage takes (spark, docs, sf_dir) and
returns a frame that is written as Parquet and read again as the next stage's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tilewright.llm.common import fresh, scratch, table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from all labels, is below a half.

    Null and empty texts have no mark and stay; rows that repeat an id or a text are scored each.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(False))
    score = fresh(docs, "_score")
    return toxicity.scored(docs, model, score).where(F.col(score) < 0.5).drop(score)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty), the document with the largest id, null least; ties by the other columns."""
    return exact_dedup.deduplicate(docs)


def distinct_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingle sets link, the one with the smallest id, nulls last; ties by a hash of the text.

    Texts without words link with nothing and stay; rows that repeat both id and text are one.
    """
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null is a source of its own. Texts without words have size 0 and count to no budget; they are taken as
    their place by hash says. Repeated rows are taken one by one.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of tokens; a null or empty text is its end id only."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", distinct_texts),
    ("ngram_join", distinct_classes),
    ("mixing", mixed),
    ("packing", packed),
]

#: Scores, shingle classes and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its rows are written
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", stays=1)
    return STAGES[-1][1](spark, docs, sf_dir)
