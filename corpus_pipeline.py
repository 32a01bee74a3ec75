"""From raw documents to training ids: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them for the next; as the
order of rows doesn't outlast that, it has the mix give each copy's training position, and returns it.

Defined results follow from the operators': an empty table gives an empty result; null and empty texts
pass the first three stages, take no words of the mix and so have no ids; rows equal in doc_id and text
are one after the second stage; a document that is repeated in the mix has a row for each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm import mixing, ngram_join, pieces, repeats, toxicity
from lookalike.llm.common import ARROW_ROWS, cut, table


#: Column of the training position in what ``run`` returns.
POSITION = "position"


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches have ARROW_ROWS rows at most from here on: texts are long, and batches lie outside
    the executors' heaps. Stages run after they return, so the setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't predicted toxic."""
    short_batches(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of shingle sets with a Jaccard similarity of 0.8 or more."""
    short_batches(spark)
    return ngram_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that one with a smaller doc_id has."""
    short_batches(spark)
    return repeats.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str, position_column: str | None = None) -> DataFrame:
    """Copies of documents in training order, each source at its target."""
    return mixing.mix(docs, position_column=position_column)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, position_column: str | None = None) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every copy, and its training position if its column is named."""
    short_batches(spark)
    placed = [] if position_column is None else [position_column]
    rows = pieces.encode(docs, keep=("doc_id", "lang", "source", *placed))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", *placed)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("pieces", encode_pieces),
]

#: Neither cosine neighbours nor Viterbi paths are SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if stage is source_mix:
            docs = source_mix(spark, docs.drop(POSITION), sf_dir, POSITION)
        elif stage is encode_pieces:
            docs = encode_pieces(spark, docs, sf_dir, POSITION)
        else:
            docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
