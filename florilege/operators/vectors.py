"""Similarity counts over dense vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.runtime import prepare

#: Vectors of a block, about: two blocks are one call, with the square of this in similarities.
BLOCK = 4096


def similar_counts(rows: DataFrame, key: str, vector: str, threshold: float, groups: list[str] | None = None) -> DataFrame:
    """key and df: the rows, itself included, whose cosine with it reaches the threshold, within groups.

    A group's rows are dealt into blocks, as many as it needs; each two blocks, and each block with itself, are one call, so that no
    pair of rows is ever a row, and a worker holds two blocks at a time. Bytes shuffled grow with the square of a group, as
    the definition's work does. A zero vector resembles nothing; a null key counts like any other."""
    prepare(rows.sparkSession)
    groups = groups or []
    kind = {c: rows.schema[c].dataType.simpleString() for c in [key, *groups]}
    dealt = rows.select(*groups, F.col(key), F.col(vector).cast("array<double>").alias("v"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups], F.lit(True))
    sizes = rows.groupBy(*[F.col(g).alias(f"_{g}") for g in groups]).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK))).cast("int").alias("n"))
    dealt = dealt.join(sizes, same) if groups else dealt.withColumn("n", F.lit(sizes.first().n))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(key), F.col("n")).cast("int"))
    pair = [*groups, "b", "c"]
    left = dealt.select(*groups, key, "v", F.col("own").alias("b"), F.explode(F.sequence(F.col("own"), F.col("n") - 1)).alias("c"))
    # Columns of their own: both sides come from the same rows, and if these were joined, Spark takes a shared column for ambiguous.
    right = dealt.select(*[F.col(c).alias(c) for c in [*groups, key, "v"]], F.explode(F.sequence(F.lit(0), F.col("own"))).alias("b"), F.col("own").alias("c"))

    def unit(found: pd.Series) -> np.ndarray:
        v = np.array(found.tolist(), np.float64)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    def counted(part: pd.DataFrame, hits: np.ndarray) -> pd.DataFrame:
        return part[[*groups, key]].assign(df=hits.astype(np.int64))

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(other):
            return counted(one[:0], np.zeros(0))
        hits = unit(one["v"]) @ unit(other["v"]).T >= threshold - 1e-12
        mine = counted(one, hits.sum(axis=1))
        return mine if one["b"].iloc[0] == one["c"].iloc[0] else pd.concat([mine, counted(other, hits.sum(axis=0))])

    schema = ", ".join(f"{c} {kind[c]}" for c in [*groups, key]) + ", df bigint"
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(run, schema).groupBy(*groups, key).agg(F.sum("df").alias("df"))


def inverse_frequency(counts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """counts with idf: ln(N / df) over its maximum. Where that is 0 (one row, or all alike) idf is null."""
    groups = groups or []
    totals = counts.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min("df").alias("_least"))
    rows = counts.join(totals, groups) if groups else counts.crossJoin(totals)  # one row of totals
    raw, most = F.ln(F.try_divide("_n", "df")), F.ln(F.try_divide("_n", "_least"))
    return rows.withColumn("idf", F.try_divide(raw, most)).drop("_n", "_least")
