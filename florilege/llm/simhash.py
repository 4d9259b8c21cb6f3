"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most 4 bits are linked. The distinct fingerprints are dealt into buckets: with
the 64 bits cut into m blocks, two linked fingerprints agree in at least m - 4 whole blocks, so each choice of
m - 4 blocks gives a trie whose top levels must match exactly, and the fingerprints below one top node are one
bucket. m follows the number of distinct fingerprints, so that buckets stay small; every m finds every link. A bucket of more
than HOT fingerprints is cut again: of BUDGET + 1 parts of its other bits, two linked fingerprints agree in one at least, so each
part gives smaller buckets, and together they hold every link of the large one.

In a bucket the trie (paths without branches compressed) joins itself: node pairs are taken down together, the
differing bits of their fixed prefixes are added up, and a pair is pruned when they exceed the budget. A pair
whose leaves are known to be in one group already is left too: only connections are needed, so a bucket gives a
spanning forest, never all pairs of a group of copies. Pairs are processed depth first in chunks, which bounds
memory by the bucket's size.

Exact copies share a fingerprint and are one leaf. Null, empty and blank texts have fingerprint 0 and are linked
like any other. Texts may be of any length: shingles are added up in blocks. Null ids take part, but a component's id is its smallest id that is not null. Repeated rows get
equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import map_rows
from florilege.runtime import prepare, written

BUDGET, SHINGLE, SEED = 4, 4, 42
#: Node pairs taken at once, rows of whole buckets gathered before they are joined, and shingles added up at once.
CHUNK, GATHER, BLOCK = 200_000, 200_000, 100_000
HOT = 100_000


def fingerprint(text: str | None) -> int:
    """64 bits, each the majority of that bit in the XXH64 hashes of the shingles."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    sums, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK])], np.uint64)
        sums += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_key (a hash that tells texts of one id apart)."""

    def run(columns: list[list]) -> list[list]:
        got = [fingerprint(t) for t in columns[1]]
        return [columns[0], [f - (1 << 64) if f >> 63 else f for f in got], columns[2]]

    rows = df.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col)))
    return map_rows(rows, run, "doc_id long, fp long, text_key long")


def _split(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The first index of each sorted run whose fingerprint has the bit."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        right = (fp[np.minimum(mid, len(fp) - 1)] & bit) != 0
        hi = np.where(open_ & right, mid, hi)
        lo = np.where(open_ & ~right, mid + 1, lo)
    return lo


def _top(x: np.ndarray) -> np.ndarray:
    """The highest set bit, or 0."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(k)
    return x ^ x >> np.uint64(1)


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of i and j; a group's label is its smallest index."""
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return label
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while ((up := root[root]) != root).any():
            root = up
        label = root[label]


def trie_self_join(fp: np.ndarray, bounds: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For distinct fingerprints sorted within buckets (bounds: where buckets begin and end), each one's group:
    the index of the first fingerprint that links reach within its bucket."""
    label = np.arange(len(fp))
    lo, hi = bounds[:-1], bounds[1:]
    many = hi - lo > 1
    stack = [np.stack([lo[many], hi[many], lo[many], hi[many]])]
    runs = np.zeros(len(fp), np.int64)  # how often the label changes up to an index
    fresh = False
    while stack:
        pairs = stack.pop()
        if pairs.shape[1] > CHUNK:
            stack.append(pairs[:, CHUNK:])
            pairs = pairs[:, :CHUNK]
        if not fresh:
            runs[1:] = np.cumsum(label[1:] != label[:-1])
            fresh = True
        a, a_end, b, b_end = pairs
        one = (label[a] == label[b]) & (runs[a] == runs[a_end - 1]) & (runs[b] == runs[b_end - 1])
        a, a_end, b, b_end = pairs[:, ~one]
        same = a == b
        fork_a, fork_b = _top(fp[a] ^ fp[a_end - 1]), _top(fp[b] ^ fp[b_end - 1])
        fork = np.maximum(fork_a, fork_b)
        fixed = ~((fork << np.uint64(1)) - np.uint64(1)) * (fork > 0) | (fork == 0) * np.uint64(0xFFFFFFFFFFFFFFFF)
        fits = np.bitwise_count((fp[a] ^ fp[b]) & fixed) <= budget
        leaf = (fork == 0) & fits
        if leaf.any():
            label = _unite(label, a[leaf], b[leaf])
            fresh = False
        keep = fits & (fork > 0)
        own, cross_a, cross_b = keep & same, keep & ~same & (fork_a >= fork_b), keep & ~same & (fork_a < fork_b)
        mid = _split(fp, a[own], a_end[own], fork[own])
        mid_a = _split(fp, a[cross_a], a_end[cross_a], fork[cross_a])
        mid_b = _split(fp, b[cross_b], b_end[cross_b], fork[cross_b])
        cross = [
            np.stack([a[own], mid, mid, a_end[own]]),
            np.stack([a[cross_a], mid_a, b[cross_a], b_end[cross_a]]),
            np.stack([mid_a, a_end[cross_a], b[cross_a], b_end[cross_a]]),
            np.stack([a[cross_b], a_end[cross_b], b[cross_b], mid_b]),
            np.stack([a[cross_b], a_end[cross_b], mid_b, b_end[cross_b]]),
        ]
        selves = np.concatenate([np.stack([a[own], mid, a[own], mid]), np.stack([mid, a_end[own], mid, a_end[own]])], axis=1)
        selves = selves[:, selves[1] - selves[0] > 1]
        for more in (np.concatenate(cross, axis=1), selves):  # the last is taken next: small groups join first
            if more.shape[1]:
                stack.append(more)
    return label


def masks(blocks: int, budget: int = BUDGET) -> list[int]:
    """The bits of each choice of blocks - budget of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(own, blocks - budget)]


def finer(mask: int, budget: int = BUDGET) -> list[int]:
    """The bits outside of a mask, in budget + 1 parts."""
    free = [k for k in range(64) if not mask >> k & 1]
    edges = [len(free) * k // (budget + 1) for k in range(budget + 2)]
    return [sum(1 << k for k in free[a:b]) for a, b in zip(edges, edges[1:])]


def blocks_for(n: int) -> int:
    """As many blocks as keep a bucket of evenly spread fingerprints under about a hundred."""
    return next((m for m in range(BUDGET + 1, BUDGET + 4) if n >> (64 * (m - BUDGET) // m) < 100), BUDGET + 4)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(nodes: DataFrame, n: int) -> DataFrame:
    """Links a, b between distinct fingerprints that connect what the links of all pairs connect."""
    prepare(nodes.sparkSession)
    chosen = masks(blocks_for(n))
    table = F.array([F.lit(_signed(m)) for m in chosen])
    parts_of = F.array(*[F.array([F.lit(_signed(m)) for m in finer(c)]) for c in chosen])
    dealt = nodes.select("fp", F.posexplode(table).alias("trie", "mask")).select("trie", F.col("fp").bitwiseAND(F.col("mask")).alias("top"), "fp")
    large = written(dealt.groupBy("trie", "top").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("trie", "top", F.lit(True).alias("hot")), "hot")
    dealt = dealt.join(large, ["trie", "top"], "left")
    cut = F.when(F.col("hot"), F.get(parts_of, F.col("trie"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = dealt.select("trie", "top", "fp", F.posexplode(cut).alias("part", "mask")).select(
        (F.col("trie") * (BUDGET + 1) + F.col("part")).alias("trie"), F.xxhash64("top", F.col("fp").bitwiseAND(F.col("mask"))).alias("top"), "fp"
    )
    dealt = dealt.repartition("trie", "top").sortWithinPartitions("trie", "top", "fp")

    def links(trie: np.ndarray, top: np.ndarray, signed: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((trie[1:] != trie[:-1]) | (top[1:] != top[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(trie)]]).astype(np.int64)
        fp = signed.view(np.uint64)
        # Signed order puts fingerprints with the top bit first; within a bucket the trie wants unsigned order.
        order = np.lexsort((fp, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
        fp = fp[order]
        label = trie_self_join(fp, bounds)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[label[child]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        parts: list[list[np.ndarray]] = [[c] for c in held]
        size, enough = 0, GATHER
        for batch in batches:
            for part, column in zip(parts, batch.columns):
                part.append(column.to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size < enough:
                continue
            trie, top, fp = (np.concatenate(p) for p in parts)
            last = np.flatnonzero((trie != trie[-1]) | (top != top[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield links(trie[:cut], top[:cut], fp[:cut])
            parts = [[trie[cut:]], [top[cut:]], [fp[cut:]]]
            size = len(trie) - cut
            enough = max(GATHER, 2 * size)  # a bucket that goes on is put together again when it has doubled
        trie, top, fp = (np.concatenate(p) for p in parts)
        if len(trie):
            yield links(trie, top, fp)

    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """fp, root of every linked fingerprint: roots hook on to their smallest neighbour and links are contracted until none is left."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    label = edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct().withColumn("root", F.col("fp"))
    while not edges.isEmpty():
        hook = edges.groupBy("a").agg(F.min("b").alias("up"))
        for _ in range(2):  # each root's smallest neighbour, then that one's, and so on: paths shorten by powers of two
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            hook = written(hook.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up")), "hooks")
        label = written(label.join(hook, label["root"] == hook["a"], "left").select("fp", F.coalesce("up", "root").alias("root")), "roots")
        for side in ("a", "b"):
            to = hook.select(F.col("a").alias(side), F.col("up").alias("new"))
            edges = edges.join(to, side, "left").withColumn(side, F.coalesce("new", side)).select("a", "b")
        edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return label


def _grouped(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows; root and first (the smallest id) of each distinct fingerprint."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "leaves")
    root = components(forest(nodes.select("fp"), nodes.count()))
    return docs, nodes.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row."""
    docs, linked = _grouped(df, id_col, text_col)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(df: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id that is not null (of several, the one
    whose text hashes lowest); a group of null ids keeps one row too."""
    docs, linked = _grouped(df, "doc_id", "text")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    by_fp = docs.groupBy("fp").agg(best)  # combined before the shuffle, so that a group of copies is a few rows
    kept = by_fp.join(linked, "fp").groupBy("root").agg(F.min("best").alias("best"))
    keys = ["_none", "_id", "_text"]
    kept = kept.select(F.col("best.none").alias("_none"), F.coalesce("best.doc_id", F.lit(0)).alias("_id"), F.col("best.text_key").alias("_text"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(row, F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    once = rows.join(kept, keys).dropDuplicates(keys)
    return once.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
