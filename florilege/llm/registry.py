"""The queries of this subpackage, each an operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from florilege.llm import bpe, hilbert, html, linededup, media, mixing, ordinal, quality, simhash, tokencount
from florilege.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return ordinal.select(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_documents(spark, sf_dir))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return html.main_text(pages, html.train(pages))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assigned(_documents(spark, sf_dir))


def op6_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_documents(spark, sf_dir))


def op8_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(_documents(spark, sf_dir))


def op9_simhash_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_documents(spark, sf_dir))


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.by_document(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ordinal_quality, op2_line_frequency, op3_main_text, op4_bpe_automaton, op5_hilbert_shards, op6_hypergeometric_mix, op7_transport_stream, op8_template_lines, op9_simhash_tries, op10_section_tokens)}

ORACLE_SQL: dict[str, str] = {"op2_line_frequency": quality.VERDICTS_SQL, "op8_template_lines": linededup.DIGESTS_SQL}
