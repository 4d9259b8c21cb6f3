"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

Targets: sources in order of code points (null last) weigh 5, 2, 1 and so on again, and share BUDGET times all
words by weight; a target stops at CAP times its source's words, and what exceeds it is shared again by weight
among the others until none is above. The level of sharing is found in one pass over sums by rising cap.

Blocks: a seeded hash of id, text and a number among equal rows puts a source's documents in random order; its first
bits cut it into BLOCKS blocks. A target of e times the source's words and a rest needs every block e times, and once
more the blocks from the start of the order for as long as they fit the rest. The block in which the rest ends is cut
again into BLOCKS by the next bits, and so on for DIGITS levels; at the last, single documents are taken while they fit.
Each source then takes one more document if that brings it nearer, the one whose size is nearest to what is
still missing; its block is one of those drawn. Documents are taken whole.

Tree: a source's quota is its number of blocks to draw, pass after pass; the block in which a rest ends holds the
documents that it takes alone. The quotas of all sources are split among SHARDS output shards by a
binary tree: at each node the left half gets its exact number of draws, uniformly without replacement, so that the
counts by source follow the multivariate hypergeometric law. In each pass a source's blocks are permuted by a seeded
hash, and the shards take disjoint runs of them. A document goes where the draws of its block go, and what the mix
takes is what is drawn: `taken` counts the draws that `dealt` gives it. Within a shard a seeded hash gives the order.

Documents are summed within blocks before any shuffle, so that a hot source is BLOCKS rows a task; sources and
draws are ranked by ranges and pieces, never in one task. A source has at most (CAP + 1) * BLOCKS draws, whatever its size,
and carries their shards as an array. Reruns agree: all draws are seeded hashes.

Null and empty texts have size 0 and take part. A source of size 0 has target 0. Null ids and repeated rows are
rows like any other: rows equal in id and text get numbers, and are taken one by one; which of them has which number may
differ, and is the same for what they hold. Texts may be of any length. An
empty table gives an empty result. Other columns, of whatever names, are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import WORD, numbered, running
from florilege.runtime import written

WEIGHTS, BUDGET, CAP = (5, 2, 1), 1.5, 2.0
SHARDS, SEED, BITS, DIGITS = 16, 20_077, 7, 3
BLOCKS = 1 << BITS


def _hash(*parts: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def lean(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h, the random order, of every row; rows equal in id and text have orders of their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _hash("doc_id", text).alias("key"))
    rows = numbered(rows, "doc_id", "key")
    return rows.select("doc_id", "source", "size", "key", "nth", F.when(F.col("nth") == 0, F.col("key")).otherwise(_hash("key", "nth")).alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target, from source and source_size.

    With sources by rising cap (their most over their weight), those are capped whose own level, at which all of lower cap have
    their most and all others the level by weight, costs no more than there is."""
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    placed = running(sizes, [F.col("source").isNull(), F.encode("source", "UTF-8")], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS)).cast("int") + 1)
    own = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * CAP).alias("most"))
    own = written(own.withColumn("cap", F.col("most") / F.col("weight")), "weights")
    rising = written(running(own, [F.col("cap"), F.col("source").isNull(), F.encode("source", "UTF-8")], {"fixed": F.col("most"), "fixed_weight": F.col("weight")}), "rising")
    weights = own.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    cost = F.col("fixed") + F.col("cap") * (F.lit(weights) - F.col("fixed_weight"))
    capped = rising.filter(cost <= BUDGET * total).agg(F.coalesce(F.sum("most"), F.lit(0.0)).alias("fixed"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = (BUDGET * total - capped.fixed) / (weights - capped.weight) if weights > capped.weight else float("inf")
    return own.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def _digit(level: int) -> Column:
    """The block of a row at a level: BITS bits of h, from the top, without its sign."""
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def plan(rows: DataFrame) -> DataFrame:
    """For each source: source_size, target, whole (times all is taken), and where the rest ends: cut, a prefix of digits,
    missing, the words still open within it, and taken_blocks of the first level."""
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets(sizes).withColumn("whole", whole.cast("int")).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("cut", F.lit(0).cast("long"))
    state = written(state.withColumnsRenamed({"source": "s"}), "plan")
    prefix = F.lit(0).cast("long")
    for level in range(DIGITS):
        inside = rows.join(state, _same(F.col("source"), F.col("s"))).filter(prefix == F.col("cut"))
        blocks = inside.groupBy("source", _digit(level).alias("block")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        blocks = blocks.withColumn("upto", F.sum("n").over(upto)).withColumnRenamed("source", "b")
        full = blocks.join(state.select("s", F.col("missing").alias("m")), _same(F.col("b"), F.col("s"))).filter("upto > m")
        end = full.groupBy("s").agg(F.min(F.struct("block", "upto", "n")).alias("e")).withColumnRenamed("s", "t")
        joined = state.join(end, _same(F.col("s"), F.col("t")), "left").drop("t")
        # Where everything left fits (rounding), the rest ends behind the last block.
        block = F.coalesce(F.col("e.block"), F.lit(BLOCKS - 1)).cast("long")
        used = F.coalesce(F.col("e.upto") - F.col("e.n"), F.lit(0))
        state = joined.withColumn("missing", F.col("missing") - used).withColumn("cut", F.col("cut") * BLOCKS + block)
        if level == 0:
            state = state.withColumn("taken_blocks", block.cast("int"))
        state = written(state.drop("e"), "plan")
        prefix = prefix * BLOCKS + _digit(level)
    return state


def _prefix() -> Column:
    out = F.lit(0).cast("long")
    for level in range(DIGITS):
        out = out * BLOCKS + _digit(level)
    return out


def chosen(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with times, how often the mix needs each, and `more`, whether once more than its whole source; and the state of each source."""
    state = plan(rows)
    joined = rows.join(state, _same(F.col("source"), F.col("s"))).withColumn("p", _prefix())
    at = F.struct("h", "doc_id", "nth")
    # Single documents only where a rest ends: the rows that share all DIGITS digits with it.
    edge = joined.filter(F.col("p") == F.col("cut"))
    upto = Window.partitionBy("s").orderBy("h", "doc_id", "nth").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= F.col("missing"))
    ends = edge.groupBy("s").agg(F.max(at).alias("last"), F.max("upto").alias("used")).withColumnRenamed("s", "t")
    state = state.join(ends, _same(F.col("s"), F.col("t")), "left").drop("t")
    state = written(state.withColumn("missing", F.col("missing") - F.coalesce("used", F.lit(0))), "plan")

    def with_state(state: DataFrame) -> DataFrame:
        out = rows.join(state, _same(F.col("source"), F.col("s"))).withColumn("p", _prefix())
        return out.withColumn("more", (F.col("p") < F.col("cut")) | ((F.col("p") == F.col("cut")) & F.coalesce(at <= F.col("last"), F.lit(False))))

    # One more document where that brings a source nearer to its target: the one nearest in size to what is missing.
    free = with_state(state).filter(~F.col("more") & (F.col("whole") < int(CAP)) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("missing")))
    best = free.groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "h", "doc_id", "nth")).alias("best")).withColumnRenamed("s", "t")
    state = written(state.join(best, _same(F.col("s"), F.col("t")), "left").drop("t"), "plan")
    out = with_state(state)
    extra = F.coalesce((F.col("h") == F.col("best.h")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("nth") == F.col("best.nth")), F.lit(False)) & ~F.col("more")
    return out.withColumn("more", F.col("more") | extra).withColumn("times", F.col("whole") + F.col("more").cast("int")), state


def quotas(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, draw (a number within the source) and shard: the splitting tree over the draws of all sources.

    A node splits its draws by rank of a seeded hash, of which the left child takes its exact share: the counts by source
    are a multivariate hypergeometric draw. Nodes are numbered like a heap. Ranks are counts of the draws of lower hash
    in 1,024 pieces of a node, and numbers within a piece, so that no node is one task."""
    n = F.col("whole") * BLOCKS + F.col("taken_blocks") + 1  # the last draw is the block in which the rest ends
    draws = state.select("source", F.explode(F.sequence(F.lit(0), n - 1)).alias("draw")).withColumns({"node": F.lit(1), "lo": F.lit(0), "hi": F.lit(shards)})
    left, wide = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"), F.col("hi") - F.col("lo") > 1
    for level in range((shards - 1).bit_length()):
        hashed = draws.withColumn("u", _hash(F.lit(level), "node", "source", "draw")).withColumn("piece", F.shiftrightunsigned("u", 54).cast("int"))
        pieces = hashed.groupBy("node", "piece").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("node").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.select("node", "piece", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("node")).alias("all"))
        own = F.row_number().over(Window.partitionBy("node", "piece").orderBy("u", "source", "draw"))
        ranked = hashed.withColumn("own", own).join(pieces, ["node", "piece"])
        quota = F.floor(F.col("all") * (left - F.col("lo")) / (F.col("hi") - F.col("lo")))
        goes_left = F.col("before") + F.col("own") <= quota
        draws = ranked.select(
            "source", "draw",
            F.when(wide, F.col("node") * 2 + F.when(goes_left, 0).otherwise(1)).otherwise(F.col("node")).alias("node"),
            F.when(wide & ~goes_left, left).otherwise(F.col("lo")).alias("lo"), F.when(wide & goes_left, left).otherwise(F.col("hi")).alias("hi"),
        )
        draws = written(draws, "draws")
    # The tree fixes how many draws of a source each shard gets; its blocks, in permuted order, are dealt to shards by runs.
    held = draws.groupBy("source", F.col("lo").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = held.withColumn("begin", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    return runs.select("source", "shard", F.explode(F.expr("sequence(begin, begin + n - 1)")).alias("draw"))


def deal(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """d (the source) and deal: for each pass an array of the shard of each block."""
    state = state.select(F.col("s").alias("source"), "whole", "taken_blocks")
    passes = state.select("source", F.explode(F.sequence(F.lit(0), "whole")).alias("pass"), "whole", "taken_blocks")
    n = F.when(F.col("pass") < F.col("whole"), F.lit(BLOCKS)).otherwise(F.col("taken_blocks") + 1)
    blocks = passes.select("source", "pass", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    order = Window.partitionBy("source", "pass").orderBy(_hash(F.lit("blocks"), "source", "pass", "block"), "block")
    permuted = blocks.withColumn("at", F.col("pass") * BLOCKS + F.row_number().over(order) - 1).withColumnRenamed("source", "b")
    placed = permuted.join(written(quotas(state, shards), "quotas"), _same(F.col("b"), F.col("source")) & (F.col("at") == F.col("draw")))
    each = placed.groupBy("b", "pass").agg(F.array_sort(F.collect_list(F.struct("block", "shard"))).alias("blocks"))  # BLOCKS at most
    each = each.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("pass", F.col("blocks.shard").alias("shards")))).alias("passes"))
    return each.select(F.col("b").alias("d"), F.col("passes.shards").alias("deal"))


def dealt(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows with source_size, target, shards and orders: the shard of each draw of a row, and its place in the shard's order."""
    out, state = chosen(rows)
    out = out.join(written(deal(state, shards), "deal"), _same(F.col("s"), F.col("d")))
    block = F.shiftrightunsigned("h", 64 - BITS).cast("int")
    # A document taken beyond where the rest ends belongs to the last block that is drawn.
    drawn = F.filter(
        F.transform("deal", lambda shards, c: F.when(c < F.col("whole"), F.get(shards, block)).when(F.col("more"), F.get(shards, F.least(block, F.col("taken_blocks"))))),
        F.isnotnull,
    )
    out = out.withColumn("shards", drawn)
    return out.withColumn("orders", F.transform("shards", lambda shard, c: _hash(shard, c, F.col("h"))))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards and orders (of each time a document is drawn) of every row of documents."""
    rows = dealt(written(lean(docs), "lean"))
    return rows.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"), "shards", "orders")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: every row of documents as often as it is drawn, all columns, with _mix_shard and _mix_order."""
    draws = dealt(written(lean(docs), "lean"), shards).filter(F.size("shards") > 0)
    draws = draws.select(F.col("doc_id").alias("_d"), F.col("key").alias("_g"), F.col("nth").alias("_m"), F.arrays_zip("shards", "orders").alias("_draws"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = docs.select(row, _hash("doc_id", F.coalesce(F.col("text"), F.lit(""))).alias("_key"), F.col("doc_id").alias("_id"))
    own = numbered(own, "_id", "_key")
    out = own.join(written(draws, "draws"), (F.col("_key") == F.col("_g")) & _same(F.col("_id"), F.col("_d")) & (F.col("nth") == F.col("_m"))).select("_row", F.explode("_draws").alias("_c"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], F.col("_c.shards").alias("_mix_shard"), F.col("_c.orders").alias("_mix_order"))


def in_shards(mix: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A mix dealt to partitions by shard and by runs of its order, sorted: as files, shards follow one another and are shuffled within."""
    cores = mix.sparkSession.conf.get("spark.sql.shuffle.partitions")
    runs = max(1, int(cores) // shards)  # of the hash that orders a shard, so even
    run = F.floor((F.shiftrightunsigned("_mix_order", 32) * runs) / float(1 << 32))
    return mix.repartitionById(shards * runs, (F.col("_mix_shard") * runs + run).cast("int")).sortWithinPartitions("_mix_shard", "_mix_order")


def write_mix(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the mix as Parquet, a folder for each shard, shuffled within it; a large shard is several files, each a run of its order."""
    in_shards(mix(docs, shards), shards).drop("_mix_order").write.partitionBy("_mix_shard").parquet(path)
