"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from florilege.runtime import prepare, written

#: ASCII white space of the contracts, for btrim and for regular expressions.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; an empty array for null, empty or blank texts. Cut at single blanks, which needs no regular expression."""
    even = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        even = F.replace(even, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(even, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with `nth`, from 0, among rows of equal keys. Only rows that share their keys are numbered, within the partitions
    that they were written in, after the counts of the partitions before, so that no group of them is one task."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    groups = written(rows.groupBy(*[F.col(k).alias(f"_same_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "groups")
    single = rows.join(groups, same, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    shared = written(rows.join(groups, same, "left_semi").withColumn("_part", F.spark_partition_id()), "repeats")
    parts = shared.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_same_{k}") for k in keys], F.col("_part").alias("_same_part"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_part")) - 1
    counted = shared.withColumn("nth", own).join(parts, same & (F.col("_part") == F.col("_same_part")))
    return single.unionByName(counted.withColumn("nth", F.col("nth") + F.col("_before")).select(*single.columns))


def running(rows: DataFrame, keys: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with sums up to and with each row in the order of keys: rows of ranges in order, added up within, after the sums of the ranges before."""
    dealt = written(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranges")
    before, upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range").orderBy(*keys)  # a row for each partition
    ranges = dealt.groupBy("range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    ranges = ranges.select("range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    own = dealt.withColumns({n: F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()}).join(ranges, "range")
    return own.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("range", *[f"_{n}" for n in sums])


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows of df, the same on each run: those whose keys hash lowest, but for rows left out by a threshold
    on the hash that lets a tenth more than `most` pass, so that tasks send on only what may be chosen."""
    n = df.count()
    if n <= most:
        return df
    order = F.xxhash64(*keys)
    near = F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * most / n + 1e-6))
    return df.filter(near).orderBy(F.pmod(order, F.lit(1 << 30)), order, *keys).limit(most)


def map_rows(df: DataFrame, function: Callable[[list[list]], list[list]], ddl: str, after: Callable[[], None] | None = None) -> DataFrame:
    """df through function(columns) -> columns, by Arrow batches: lists of Python values in and out. after runs when a
    partition is done; workers outlive their tasks, so what they keep is memory that later stages lack."""
    prepare(df.sparkSession)
    schema: StructType = _parse_ddl(df.sparkSession, ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function([column.to_pylist() for column in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow)], schema=arrow)
        if after:
            after()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _parse_ddl(spark: SparkSession, ddl: str) -> StructType:
    return _parse_datatype_string(ddl)
