import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from florilege.llm import ordinal, simhash


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    # Near copies of one text are all trained on or all held out.
    labels = labels.join(simhash.groups(docs).select("doc_id", "component_id").distinct(), "doc_id").cache()
    model = ordinal.train(docs, labels.filter("component_id % 5 <> 0").drop("component_id"))
    assert (np.diff(model.thresholds) > 0).all()
    held = ordinal.rated(labels.filter("component_id % 5 = 0"))
    got = ordinal.select(docs, model).join(held, "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("e")).orderBy("grade").collect()
    assert got[0].kept < 0.1 and got[1].kept < 0.35 and got[2].kept > 0.96
    assert got[0].e < got[1].e < got[2].e


def test_gradient_finds_the_likeliest():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 30, 8).tolist())) for _ in range(400)]
    z = np.array([sum(1 if b < 10 else -1 if b > 20 else 0 for b in r) for r in rows])
    grades = np.digitize(z + rng.normal(size=400), [-1.5, 1.5])
    model = ordinal.fit(rows, grades.tolist(), steps=300)
    got = np.array([model.score(r) for r in rows])
    assert np.corrcoef(got, z)[0, 1] > 0.85
    above = model.above(got)
    assert (above[:, 0] >= above[:, 1]).all()


def loss(weights, bounds, rows, grades):
    """Mean negative log likelihood, one document after another."""
    total = 0.0
    for r, y in zip(rows, grades):
        z = sum(weights[b] for b in r)
        above = [1.0, *[1 / (1 + np.exp(b - z)) for b in bounds], 0.0]
        total -= np.log(above[y] - above[y + 1])
    return total / len(rows)


def test_fit_is_stationary():
    """No step in any weight or threshold that is open to the fit lowers the loss, by the loss itself rather than its gradient."""
    rng = np.random.default_rng(1)
    rows = [sorted(set(rng.integers(0, 12, 5).tolist())) for _ in range(500)]
    grades = np.digitize([sum(1 if b < 4 else -1 if b > 8 else 0 for b in r) + rng.normal() for r in rows], [-1, 1]).tolist()
    model = ordinal.fit(rows, grades, steps=3000, rate=0.02, penalty=0.0)
    weights, bounds = model.weights[:12].astype(float), model.thresholds.astype(float)
    best = loss(weights, bounds, rows, grades)
    for values in (weights, bounds):
        for k in range(len(values)):
            if values is weights and not weights[k]:
                continue  # too rare to tell
            for step in (-0.05, 0.05):
                moved = values.copy()
                moved[k] += step
                assert loss(moved if values is weights else weights, moved if values is bounds else bounds, rows, grades) > best - 1e-6


def test_scores_are_brute_force(docs, odd):
    rng = np.random.default_rng(2)
    model = ordinal.Model(rng.normal(size=ordinal.BUCKETS).astype(np.float32) / 8, np.array([-0.5, 0.75]))
    for df in (docs, odd):
        got = sorted((r.doc_id or -1, r.expected_grade, r.tail_probability, r.kept) for r in ordinal.select(df, model).collect())
        want = []
        for r in df.select("doc_id", "text").collect():
            tokens = {t for word in (r.text or "").lower().split() for t in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", word)}
            z = sum(float(model.weights[b]) for b in sorted({zlib.crc32(t.encode()) % ordinal.BUCKETS for t in tokens}))
            above = [1 / (1 + np.exp(-(z - t))) for t in model.thresholds]
            want.append((r.doc_id or -1, sum(above), above[-1]))
        for g, w in zip(got, sorted(want)):
            assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-4 and abs(g[2] - w[2]) < 1e-4 and g[3] == (g[2] >= ordinal.TAIL)


def test_worker_s_memory_is_bounded():
    ordinal._forget()
    ordinal.features("x" * 1000 + "-" + "y" * 1000 + " short " + "中文。" * 100_000)
    assert set(ordinal._KNOWN) == {"short"} and len(ordinal.features("ab " * 1_000_000)) == 1


def test_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (8, None, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ordinal.rated(labels).collect()} == {5: 0, 8: 0, 9: 2}
    out = ordinal.select(odd, ordinal.train(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert len({r.tail_probability for r in out if r.doc_id in (1, 2, 3)}) == 1
    empty = ordinal.train(odd, labels.limit(0))
    assert not empty.weights.any() and ordinal.select(nothing, empty).count() == 0
