"""A corpus pipeline of five operators: quality, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever their names, and rows as the operators define for odd cases:
a null or empty text is kept by quality (importance 0) if others of importance 0 are, is not toxic, has no near-duplicate,
is mixed once and packed as one end id; a null doc_id is a document like others; rows of equal doc_id and text are
one after the third stage, those of one doc_id and unlike texts stay apart; ties in the importance are all kept; an
empty table gives an empty result, and without labels nothing is rejected. What an operator left in the shared folder for a stage is
deleted when the next stage begins, for by then the stage's result has been written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import forest, mixing, packing, quality, queries, scratch, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def stage(f: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        scratch.remove(spark, _left.pop(app, []))
        before = set(scratch.made(spark))
        out = f(spark, docs, sf_dir)
        _left[app] = [x for x in scratch.made(spark) if x not in before]
        return out

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling toward the documents labelled good; what isn't sampled goes."""
    return quality.resample(docs, queries.table(spark, sf_dir, "labels"), allow=queries.QUALITY_ALLOW)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.clean(docs, toxicity.fit(queries.labelled_toxicity(spark, sf_dir, docs), queries.TOXIC_CHAIN))


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest doc_id stays."""
    return forest.keep_one(docs)


@stage
def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that expected tokens come to the languages' target weights."""
    rates = mixing.mix(docs.select("doc_id", "text", F.col("lang").alias("domain")), queries.table(spark, sf_dir, "labels"), queries.LANGUAGE_TARGETS)
    return mixing.resample(docs, rates)


@stage
def pack_powers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, as in op1."""
    return packing.digest(packing.pack(docs, queries.tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_languages),
    ("packing", pack_powers),
]
#: The models of the first stages can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = queries.table(spark, sf_dir, "documents")
    base = f"{scratch.base_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, f in STAGES[:-1]:
        f(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
