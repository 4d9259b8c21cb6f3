import math
import os

import pytest
from pyspark.sql import functions as F

from florilege.operators import clusters, models, predicates
from florilege.config import GEONAMES


def test_parser(spark):
    def fake_parser():
        def parse(texts):
            assert len(texts) <= 2
            out = []
            for text in texts:
                words = text.split()
                token = lambda i, w: dict(i=i, text=w, lower=w.lower(), pos="VERB" if w == "drink" else "NOUN", tag="VBP", dep="ROOT" if w == "drink" else "nsubj", head=1, is_space=False, like_email="@" in w)
                out.append(([token(i, w) for i, w in enumerate(words)], [dict(start=0, end=1, text=words[0], label="NORP")] if words else []))
            return out

        return parse

    rows = spark.createDataFrame([("a", "Finns drink coffee."), ("b", None), ("c", "Finns drink a@b.org tea.")], "sentence_id string, text string")
    got = {r.sentence_id: r for r in models.parser(fake_parser, size=2)(rows).collect()}
    assert got["a"].ents[0].text == "Finns" and got["b"].toks == [] and got["c"].toks[2].like_email
    noted = models.parser(fake_parser, size=2)(rows)
    assert {r.sentence_id for r in noted.filter(predicates.PREDICATES["has-no-email"](GEONAMES)).collect()} == {"a", "b"}


def test_classifier_encoder_and_summariser(spark):
    rows = spark.createDataFrame([(str(k), f"text {k} " * k) for k in range(70)], "sentence_id string, text string").repartition(3)
    scorer = models.classifier(lambda: lambda texts, labels: [[len(t) / 1000, 0.5] for t in texts], ["food", "drink"])
    got = {r.sentence_id: r.scores for r in scorer(rows).collect()}
    assert len(got) == 70 and got["69"] == {"food": len("text 69 " * 69) / 1000, "drink": 0.5}
    vectors = {r.sentence_id: r.embedding for r in models.encoder(lambda: lambda texts: [[len(t), 3.0, 0.0] for t in texts])(rows).collect()}
    assert all(math.isclose(sum(x * x for x in v), 1.0) for v in vectors.values())
    members = spark.createDataFrame([(1, "a"), (1, "bb"), (1, "ccc"), (2, "z")], "k int, text string")
    reps = clusters.representatives(members, ["k"], models.summariser(lambda: lambda prompts: [f" {p.count('(')} texts. " for p in prompts]))
    assert {r.k: r.rep for r in reps.collect()} == {1: "3 texts.", 2: "z"}
    with pytest.raises(Exception, match="one result"):
        models.encoder(lambda: lambda texts: [[1.0]])(rows).collect()


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[1.0] for _ in texts]

    models.encoder(load)(spark.range(100).select(F.lit("x").alias("text")).repartition(20)).count()
    seen = open(log).read().split()
    assert len(seen) == len(set(seen))
