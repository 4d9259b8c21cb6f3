"""Joins between the tables of sentences, and filters that cross them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.config import Settings


def in_files(sentences: DataFrame, files: list[str] | DataFrame) -> DataFrame:
    """Sentences of the given files; of all, given none."""
    if isinstance(files, DataFrame):
        return sentences.join(files.select("file_path").distinct(), "file_path", "left_semi")
    return sentences.filter(F.col("file_path").isin(*files)) if files else sentences


def generic_only(rows: DataFrame, generic: DataFrame) -> DataFrame:
    """Rows of generic sentences."""
    return rows.join(generic.filter("is_generic").select("sentence_id").distinct(), "sentence_id", "left_semi")


def not_yet(rows: DataFrame, done: DataFrame, key: str = "sentence_id", overwrite: bool = False) -> DataFrame:
    """Rows whose key isn't done; all of them on overwrite."""
    return rows if overwrite else rows.join(done.select(key).distinct(), key, "left_anti")


def labelled(labels: DataFrame, sentences: DataFrame) -> DataFrame:
    return labels.join(sentences, "sentence_id")


def passes(scores: Column, facet: str, s: Settings) -> Column:
    """Whether a map of scores has the facet and every required label at the positive threshold or above, and every
    counter label at the negative one or below. A missing score fails either way: it compares to null."""
    get = lambda k: F.try_element_at(scores, F.lit(k))
    test = get(facet) >= s.positive_threshold
    for label in s.counter_labels:
        test = test & (get(label) <= s.negative_threshold)
    for label in s.required_labels:
        if label != facet:
            test = test & (get(label) >= s.positive_threshold)
    return test


def expand(rows: DataFrame, ids: str = "sentence_ids") -> DataFrame:
    """A row for each id of an array, as sentence_id."""
    return rows.withColumn("sentence_id", F.explode(ids)).drop(ids)


def members(clusters: DataFrame, sentences: DataFrame) -> DataFrame:
    """The sentences of clusters; ids without a sentence vanish."""
    return expand(clusters).join(sentences, "sentence_id")


def named(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Clusters with subject, the short name of their node."""
    return clusters.join(nodes.select("node_id", F.col("short_name").alias("subject")), "node_id")
