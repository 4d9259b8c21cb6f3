"""Clustering sentences of a node and facet, and representatives of clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.runtime import prepare


#: Cells of a block of gaps that a worker holds at once, in 4 bytes each.
CELLS = 1 << 22


def ward(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of unit vectors by Ward linkage, cut where merges reach the threshold: the first member of each.

    In rounds, all pairs of clusters that are nearest to each other merge, and only clusters whose nearest one has merged look
    again, by blocks of a matrix product; as a merge never comes nearer to others than its parts were, this is the tree of one
    merge after another. Equal vectors are one point from the start, and clusters without one nearer than the threshold are done.
    Memory follows n times d, not n squared."""
    n = len(vectors)
    if n < 2 or not threshold > 0:
        return np.arange(n)
    vectors = np.asarray(vectors, np.float64) + 0.0  # no negative zeros
    sound = np.isfinite(vectors).all(axis=1)
    if not sound.all():  # vectors that hold no number somewhere stay alone
        label, some = np.arange(n), np.flatnonzero(sound)
        label[some] = some[ward(vectors[some], threshold)]
        return label
    _, first, owner, size = np.unique(vectors, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)  # points by their first row
    owner = np.argsort(order)[owner.ravel()]
    first, centre, size = first[order], vectors[first[order]], size[order].astype(np.float64)
    into = np.arange(len(centre))
    at = np.arange(len(centre))  # the points that are live clusters, by first member
    near, gap = np.zeros(len(centre), np.int64), np.full(len(centre), np.inf)
    look = at
    while len(at) > 1:
        if len(look):
            near[look], gap[look] = _nearest(centre, size, at, look)
        at = at[np.sqrt(gap[at]) < threshold]
        mutual = at[(near[near[at]] == at) & (at < near[at])]
        if not len(mutual) and len(look) < len(at):  # ties only
            look = at
            continue
        if not len(mutual):
            break
        a, b = mutual, near[mutual]
        total = size[a] + size[b]
        centre[a] = (size[a, None] * centre[a] + size[b, None] * centre[b]) / total[:, None]
        size[a], into[b] = total, a
        merged = np.zeros(len(centre), bool)
        merged[a] = merged[b] = True
        at = at[into[at] == at]
        look = at[merged[at] | merged[near[at]]]
    for k in range(len(into)):  # a cluster goes into an earlier one
        into[k] = into[into[k]]
    return first[into[owner]]


def _nearest(centre: np.ndarray, size: np.ndarray, at: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster of look the nearest other one of `at` (ties: the first) and the square of the height at which they merge.

    Products in 4 bytes leave those that may be nearest, within the error of the products; differences in 8 bytes decide."""
    near, gap = np.zeros(len(look), np.int64), np.full(len(look), np.inf)
    if len(at) < 2:
        return near, gap
    points = centre[at]
    square = (points**2).sum(axis=1)
    one = np.ones(len(at))
    right = np.column_stack((points, one, square)).astype(np.float32).T.copy()
    share = (1 / size[at]).astype(np.float32)
    error = 8 * (points.shape[1] + 4) * float(np.finfo(np.float32).eps) * float(square.max())
    place = np.searchsorted(at, look)
    step = max(1, CELLS // len(at))
    for lo in range(0, len(look), step):
        mine = place[lo : lo + step]
        block = np.column_stack((-2 * points[mine], square[mine], one[mine])).astype(np.float32) @ right
        block /= share[mine, None] + share
        block[np.arange(len(mine)), mine] = np.inf
        least = block.min(axis=1).astype(np.float64)
        upto = least + error * size[at[mine]] + 1e-6 * np.abs(least)
        row, col = np.nonzero(block <= upto[:, None].astype(np.float32))
        exact = np.empty(len(row))
        for k in range(0, len(row), 1 << 16):
            i, j = at[mine[row[k : k + (1 << 16)]]], at[col[k : k + (1 << 16)]]
            exact[k : k + (1 << 16)] = ((centre[j] - centre[i]) ** 2).sum(axis=1) * (2 * size[i] * size[j] / (size[i] + size[j]))
        starts = np.searchsorted(row, np.arange(len(mine)))
        least = np.minimum.reduceat(exact, starts)
        best = np.flatnonzero(exact == least[row])
        pick = best[np.unique(row[best], return_index=True)[1]]
        near[lo : lo + step], gap[lo : lo + step] = at[col[pick]], least
    return near, gap


def clustered(rows: DataFrame, threshold: float, key: str = "node_id") -> DataFrame:
    """node_id, cluster_rank (from 1: size falling, then first member) and sentence_ids; a group is at most the limit that `top` leaves.

    rows: node_id, sentence_id, position (order within the node) and embedding."""
    prepare(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position", kind="stable")
        vectors = np.array(group["embedding"].tolist(), np.float64)
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        label = ward(np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0), threshold)
        ids = group["sentence_id"].to_numpy()
        order = np.argsort(label, kind="stable")  # labels are first members, so clusters come in order of these
        found = np.split(ids[order], np.flatnonzero(np.diff(label[order])) + 1)
        found.sort(key=len, reverse=True)
        return pd.DataFrame({key: group[key].iloc[0], "cluster_rank": range(1, len(found) + 1), "sentence_ids": [list(f) for f in found]})

    ids = rows.schema["sentence_id"].dataType.simpleString()
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key).groupBy(key).applyInPandas(run, f"{key} {kind}, cluster_rank int, sentence_ids array<{ids}>")


def top(rows: DataFrame, score: str, limit: int, key: str = "node_id") -> DataFrame:
    """The best rows of each node by score, ties by sentence_id, with their position."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col("sentence_id"))
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def ranks(rows: DataFrame, key: str, size: str, first: str) -> DataFrame:
    """cluster_rank within key by size falling, then by the place of the first member."""
    return rows.withColumn("cluster_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(size).desc(), F.col(first))))


def cut(clusters: DataFrame, limit: int, least: int) -> DataFrame:
    """The clusters up to a rank, and of these the ones of a size or more."""
    return clusters.filter((F.col("cluster_rank") <= limit) & (F.size("sentence_ids") >= least))


def prompts(members: DataFrame, keys: list[str], limit: int = 1800, domain: str | None = None, place: str | None = None) -> DataFrame:
    """keys and prompt: a header, the distinct texts by length as numbered lines until the joined prompt exceeds the limit, and a footer."""
    about = f" about {domain} in {place}:" if domain and place else " sorted by length:"
    header = f"Given the following sentences{about}\n"
    footer = "\nSummarize them using one sentence:"
    texts = members.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.length("text").alias("n"), F.col("text").alias("t")))).alias("texts"))
    lines = F.transform("texts", lambda x, k: F.concat(F.lit("("), (k + 1).cast("string"), F.lit(") "), x["t"]))
    start = F.struct(F.lit(header).alias("out"), F.lit(True).alias("open"))

    def add(state, line):  # noqa: ANN001, ANN202
        longer = F.concat(state["out"], F.lit("\n"), line)
        return F.when(state["open"], F.struct(longer.alias("out"), (F.length(longer) <= limit).alias("open"))).otherwise(state)

    return texts.select(*keys, F.concat(F.aggregate(lines, start, add)["out"], F.lit("\n" + footer)).alias("prompt"))


Summariser = Callable[[DataFrame], DataFrame]


def representatives(members: DataFrame, keys: list[str], summarise: Summariser | None = None, limit: int = 1800) -> DataFrame:
    """keys and rep: the shortest text (ties: the first in order) of clusters with at most two distinct texts in lower case.

    Others go to a summariser, which takes keys and prompt and returns keys and rep; offline the shortest text stands in."""
    own = members.groupBy(*keys).agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("rep"), F.countDistinct(F.lower("text")).alias("n_texts"))
    if summarise is None:
        return own.select(*keys, "rep")
    few = own.filter("n_texts <= 2").select(*keys, "rep")
    many = members.join(own.filter("n_texts > 2").select(*keys), keys, "left_semi")
    return few.unionByName(summarise(prompts(many, keys, limit)).select(*keys, F.trim("rep").alias("rep")))
