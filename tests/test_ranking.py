import numpy as np
import pytest
from pyspark.sql import functions as F

from florilege.config import GEONAMES
from florilege.operators import clusters, joins, matching, ranking, vectors


def naive_ward(points, threshold):
    groups = {k: [k] for k in range(len(points))}
    while len(groups) > 1:
        def height(a, b):
            ca, cb = points[groups[a]].mean(axis=0), points[groups[b]].mean(axis=0)
            na, nb = len(groups[a]), len(groups[b])
            return (2 * na * nb / (na + nb)) ** 0.5 * float(np.linalg.norm(ca - cb))

        best = min((height(a, b), a, b) for a in groups for b in groups if a < b)
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed, threshold", [(1, 0.8), (2, 1.2), (3, 1.5), (4, 2.5)])
def test_ward_is_naive_ward(seed, threshold):
    points = np.random.default_rng(seed).normal(size=(40, 5))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    label = clusters.ward(points, threshold)
    assert sorted(sorted(np.flatnonzero(label == k).tolist()) for k in set(label)) == naive_ward(points, threshold)
    assert clusters.ward(points[:1], threshold).tolist() == [0] and len(clusters.ward(points[:0], threshold)) == 0


def test_ward_looks_again_only_where_needed(monkeypatch):
    looks, nearest = [], clusters._nearest
    monkeypatch.setattr(clusters, "CELLS", 64)
    monkeypatch.setattr(clusters, "_nearest", lambda centre, size, at, look: (looks.append(len(look)), nearest(centre, size, at, look))[1])
    points = np.random.default_rng(6).normal(size=(60, 5))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = np.concatenate([points, np.repeat(points[:3], 1000, axis=0), [[np.nan] * 5]])
    label = clusters.ward(rows, 1.2)
    naive = naive_ward(points, 1.2)
    assert sum(looks) <= 4 * len(points)
    weighed = clusters.ward(np.concatenate([points[:3], points[:3]]), 0.1).tolist()
    assert weighed == [0, 1, 2, 0, 1, 2] and label[-1] == len(rows) - 1
    assert all((label[60 + 1000 * k : 1060 + 1000 * k] == label[k]).all() for k in range(3))
    plain = clusters.ward(points, 1.2)
    assert sorted(sorted(np.flatnonzero(plain == k).tolist()) for k in set(plain)) == naive
    assert clusters.ward(np.ones((5, 2)), 1.2).tolist() == [0] * 5 and clusters.ward(points, 0.0).tolist() == list(range(60))


def test_clustered(spark):
    rows = [("n", str(k), k, [1.0, 0.01 * k] if k % 3 else [-1.0, 0.0]) for k in range(9)] + [("m", "x", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "node_id string, sentence_id string, position int, embedding array<double>")
    got = {(r.node_id, r.cluster_rank): r.sentence_ids for r in clusters.clustered(df, 1.5).collect()}
    assert got == {("n", 1): ["1", "2", "4", "5", "7", "8"], ("n", 2): ["0", "3", "6"], ("m", 1): ["x"]}


def test_cut_is_rank_before_size(spark):
    df = spark.createDataFrame([("n", 1, ["a"]), ("n", 2, ["a", "b", "c"]), ("n", 3, ["a"] * 9)], "node_id string, cluster_rank int, sentence_ids array<string>")
    assert [r.cluster_rank for r in clusters.cut(df, 2, 3).collect()] == [2]


def test_thresholds_are_inclusive_and_missing_keys_fail(spark):
    rows = [("a", {"food": 0.5, "business": 0.3, "politics": 0.0, "advertisement": 0.0}), ("b", {"food": 0.9, "business": 0.0}), ("c", {"food": 0.49, "business": 0.0, "politics": 0.0, "advertisement": 0.0})]
    df = spark.createDataFrame(rows, "id string, scores map<string,double>")
    assert [r.id for r in df.filter(joins.passes(F.col("scores"), "food", GEONAMES)).collect()] == ["a"]


def test_overlapping_aliases_and_first_match(spark):
    names = spark.createDataFrame([("Sunni Islam", "s"), ("Islam", "i"), ("Muslims", "i")], "alias string, node_id string")
    df = spark.createDataFrame([("1", ["sunni", "islam"]), ("2", ["muslims", "of", "islam"]), ("3", [])], "sentence_id string, words array<string>")
    got = matching.first_matches(matching.gazetteer_matches(df, names))
    assert sorted((r.sentence_id, r.node_id, r.match_text, r.match_start, r.match_end) for r in got.collect()) == [("1", "i", "islam", 1, 2), ("1", "s", "sunni islam", 0, 2), ("2", "i", "muslims", 0, 1)]
    assert matching.gazetteer_matches(df, names.limit(0)).count() == 0


def test_few_aliases_are_broadcast(spark, monkeypatch):
    names = spark.createDataFrame([("Sunni Islam", "s"), ("Islam", "i")], "alias string, node_id string")
    df = spark.range(20).select(F.col("id").alias("sentence_id"), F.array(F.lit("sunni"), F.lit("islam")).alias("words"))
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    few = matching.gazetteer_matches(df, names)
    assert plan(few).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan(few)
    monkeypatch.setattr(matching, "FEW", 0)
    many = matching.gazetteer_matches(df, names)
    assert "SortMergeJoin" in plan(many) and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and few.count() == 40


def test_diversity_at_the_ratio(spark):
    df = spark.createDataFrame([("k", "A", None), ("k", "b", ""), ("k", "a", None), ("j", "x", "http://a/"), ("j", "X", "http://b/")], "k string, text string, url string")
    got = {r.k: (r.n, r.n_texts, r.n_domains, r.diverse) for r in ranking.diversity(df, ["k"]).collect()}
    assert got == {"k": (3, 2, 2, True), "j": (2, 1, 2, False)}


def test_representatives(spark):
    df = spark.createDataFrame([("c", "Longer text"), ("c", "text"), ("c", "TEXT"), ("d", "a"), ("d", "b"), ("d", "cc")], "k string, text string")
    summarise = lambda p: p.select("k", F.concat(F.lit(" sum "), F.length("prompt").cast("string"), F.lit(" ")).alias("rep"))
    got = {r.k: r.rep for r in clusters.representatives(df, ["k"], summarise).collect()}
    assert got["c"] == "TEXT" and got["d"].startswith("sum")


def test_idf_of_one_row_is_null_and_dropped(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<double>")
    out = vectors.inverse_frequency(vectors.similar_counts(df, "id", "v", 0.8))
    assert out.first().idf is None
    rows = out.select("id", "idf", F.lit(1.0).alias("prob"), F.lit(1.0).alias("tf"), F.lit(1.0).alias("noun_density"), F.lit(1).alias("has_subjects"), F.lit(True).alias("passes"))
    assert ranking.combined(rows).filter("combined_score > 0").count() == 0


def test_similar_counts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    points = np.random.default_rng(5).normal(size=(40, 3))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id int, v array<double>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = dict(enumerate((unit @ unit.T >= 0.3).sum(axis=1).tolist()))
    assert {r.id: r.df for r in vectors.similar_counts(df, "id", "v", 0.3).collect()} == want
    assert vectors.similar_counts(df.limit(0), "id", "v", 0.3).count() == 0


def test_similar_counts_of_joined_rows(spark):
    df = spark.createDataFrame([("a", "p", [1.0, 0.0]), ("b", "p", [0.9, 0.1]), ("c", None, [0.9, 0.1])], "id string, g string, v array<double>")
    joined = df.join(df.select("id").distinct(), "id")
    assert {r.id: r.df for r in vectors.similar_counts(joined, "id", "v", 0.8).collect()} == {"a": 3, "b": 3, "c": 3}
    for rows in (df, joined):
        assert {(r.id, r.g): r.df for r in vectors.similar_counts(rows, "id", "v", 0.8, ["g"]).collect()} == {("a", "p"): 2, ("b", "p"): 2, ("c", None): 1}


def test_concepts_that_all_go_leave_the_row(spark):
    df = spark.createDataFrame([("1", "s1", ["food", "tea"]), ("2", "s2", ["tea"])], "id string, subject string, concepts array<string>")
    assert {r.id: r.concepts for r in ranking.good_concepts(df, "food", 2).collect()} == {"1": [], "2": []}
    assert {r.id: r.concepts for r in ranking.good_concepts(df, "food", 4).collect()} == {"1": ["tea"], "2": ["tea"]}
