"""Sharding along a Hilbert curve through metadata: rows near in several dimensions share a shard.

Dimensions are source, lang and size. Each is cut into 2**BITS - 1 buckets at quantiles over all rows: of the distinct
values in order (texts by code points, whole), cut k is the first one up to which k shares of the rows lie. So a
bucket's range of values is narrow and files can be pruned by their minima and maxima in any of them. A row's buckets give
its index on the curve; rows are put in order of the index and cut into runs.

The law is `rows`: with N rows and K shards, shard s holds the ranks from ceil(s N / K) on, so that counts are at
most one apart. A slot is the rank less the shard's first.

Ranks come without a global sort: a cell (index on the curve) holds rows in order of a hash of id and text, which
also deals a cell, however hot, into PIECES even pieces. Counts by piece are summed within cells, counts by cell
along the curve (at most 2**(3 BITS) cells, whatever the data), and rows are numbered within their piece alone. Quantiles
are of counts by distinct value, summed over ranges of values; the driver sees the cuts alone, 2**BITS - 2 a dimension.

Null metadata come first, in a bucket of their own. A null or empty text has 0 bytes. Texts may be of any length. Rows of
equal id and text are told apart by a number, so repeated rows get slots of their own; null ids are ids like any other. With fewer
rows than shards some shards are empty. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import numbered, running
from florilege.runtime import prepare, written

BITS, SHARDS, PIECES, BASE_SIZE = 4, 40, 1024, 16
DIMENSIONS = ("source", "lang", "size")


def curve_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of rows of coordinates (Skilling's transform: undo excess work, Gray-encode, interleave)."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def lean(docs: DataFrame) -> DataFrame:
    """What sharding needs of each row: ids, size, checksum, place in a cell, and the dimensions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + BASE_SIZE).cast("long")
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64("doc_id", text).alias("place"),
        F.struct("source", "lang", size.alias("size")).alias("at"),
    )


def cuts(rows: DataFrame, dimension: str, n: int) -> list:
    """The values that end the first n - 1 of n buckets of even counts, without repeats; nulls aside."""
    value = F.col(f"at.{dimension}").alias("value")
    counts = written(rows.select(value).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")), "counts")
    upto = written(running(counts, [F.col("value")], {"upto": F.col("n")}), "upto")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # The bucket that a value ends is that of its last row; the first value that reaches a share is its cut.
    reached = upto.filter(F.col("upto") * n >= F.lit(total)).withColumn("k", F.floor(F.col("upto") * n / F.lit(max(1, total))))
    firsts = {r.k: r.value for r in reached.groupBy("k").agg(F.min("value").alias("value")).filter(F.col("k") < n).collect()}
    return [firsts[k] for k in sorted(firsts)]


def quantised(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """rows with `cell`, their index on the curve."""
    prepare(rows.sparkSession)
    bounds = {d: cuts(rows, d, (1 << bits) - 1) for d in DIMENSIONS}  # a bucket is left for nulls

    def bucket(d: str) -> Column:
        value = F.col(f"at.{d}")
        above = sum((F.when(value > F.lit(c), 1).otherwise(0) for c in bounds[d]), F.lit(0))
        return F.when(value.isNull(), 0).otherwise(above + 1)

    @F.pandas_udf("int")
    def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([a, b, c], axis=1), bits).astype(np.int32))

    return rows.withColumn("cell", index(*[bucket(d) for d in DIMENSIONS]))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 0, along the curve; and `total`."""
    rows = rows.withColumn("piece", F.shiftright("place", 54).cast("int") + PIECES // 2)
    pieces = written(rows.groupBy("cell", "piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    cells = pieces.groupBy("cell").agg(F.sum("n").alias("n"))
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # of at most 2**(3 BITS) rows
    cells = cells.select("cell", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("begin"))
    within = Window.partitionBy("cell").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("cell", "piece", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before")).join(cells, "cell")
    before = written(before.select("cell", "piece", (F.col("begin") + F.col("before")).alias("offset")), "offsets")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = Window.partitionBy("cell", "piece").orderBy("place", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(before, ["cell", "piece"]).withColumn("rank", F.col("offset") + F.col("own")).withColumn("total", F.lit(total))


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and cell of every row of documents."""
    rows = ranked(quantised(written(lean(docs), "lean")))
    shard = F.expr(f"(rank * {shards}) div total")
    rows = rows.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the rows of documents as Parquet, one folder `shard=s` for each shard; a large shard is several files, each a run
    of its slots. A column named shard is replaced."""
    rows = ranked(quantised(written(lean(docs), "lean")))
    placed = numbered(rows.select("place", "rank"), "place").select(F.col("place").alias("_place"), F.col("nth").alias("_nth"), F.col("rank").alias("_rank"))
    total = rows.select("total").first()
    if total is None:
        return docs.withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(path)
    key = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).alias("_own")
    own = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("_row"), key), "_own")
    joined = own.join(placed, (F.col("_own") == F.col("_place")) & (F.col("nth") == F.col("_nth")))
    runs = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards) * shards
    cut = lambda k: F.expr(f"cast((_rank * {k}) div {total[0]} as int)")
    dealt = joined.withColumns({"_shard": cut(shards), "_run": cut(runs)}).repartitionById(runs, F.col("_run")).sortWithinPartitions("_rank")
    dealt.select("_row.*", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
