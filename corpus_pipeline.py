"""From raw documents to token ids: each stage takes the documents that the one before it kept.

Stages are separate jobs: each result is written as Parquet in the shared folder and read again, so that a lost
executor costs the stage that runs and no other. An empty table of documents stays empty to the end. Texts may be of any
length; columns of any names pass through all stages but the last; ties have an order that reruns repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from florilege.llm import bpe, linededup, mixing, quality, simhash
from florilege.llm.registry import vocabulary
from florilege.runtime import spread, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or consist of their host's boilerplate go; boilerplate lines go from the others.

    Null, empty and blank texts have no words and go. A null source is a host of its own."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; of what only copies hold, one text keeps it.

    Null texts stay null; a text that loses all its lines stays as an empty one. Equal texts lose the same lines."""
    return linededup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id; a group of null ids keeps one too.

    Null, empty and blank texts are one group. Of repeated rows one stays."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them: some not at all, some twice. The files hold the output shards one after another, shuffled within.

    Texts without a word have size 0 and may be drawn; a null source is the last one. Rows equal in id and text are drawn one by one."""
    return mixing.in_shards(mixing.mix(docs)).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of each document. Null texts are empty ones, and have no tokens."""
    return bpe.digests(docs, vocabulary("word_bpe_49k.json"), release=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: Near-duplicate groups and BPE can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
