import json

import pytest
from pyspark.sql import functions as F

from florilege.config import RELIGIONS
from florilege.operators.annotate import lexicon_scorer
from florilege.plans import stages
from florilege.sources import files
from florilege.streaming.incremental import arrivals

TEXT = "{0} people are drinking green tea in winter. {0} people are drinking black tea in summer. {0} people are drinking green tea in temples. Rain falls."


@pytest.fixture
def context(spark, tmp_path):
    from dataclasses import replace

    (tmp_path / "g.tsv").write_text("name\taliases\nIslam\tIslam,Muslim\nBuddhism\tBuddhist, ,Zen\n")
    docs = [{"text": TEXT.format(w), "url": f"http://h{k}.org/"} for k, w in enumerate(["Muslim", "Buddhist", "Muslim", "Buddhist"])]
    docs += [{"text": "Zen people are brewing coffee in cold winter. Zen people are brewing coffee in hot summer. Zen people are brewing coffee in monasteries."}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, docs)))
    nodes, aliases = files.gazetteer(spark, str(tmp_path / "g.tsv"))
    corpus = files.corpus(spark, str(tmp_path / "c.json")).withColumns({"file_path": F.lit("c.json"), "doc_i": F.monotonically_increasing_id().cast("int")})
    settings = replace(RELIGIONS, counter_labels=(), required_labels=(), excluded_filters=("root-has-nsubj-or-nsubjpass", "first-word-is-not-verb", "remove-present-participle-roots"), min_cluster_size=2, ward_threshold=1.2)
    scorer = lexicon_scorer({"drink": ["tea", "coffee"], "food": ["rice"]})
    return stages.Context(spark, str(tmp_path / "tables"), settings, corpus, nodes, aliases, "drink", ["Islam", "Buddhism"], str(tmp_path / "out"), scorer=scorer)


def test_six_stages(spark, context):
    stages.run(context, 1, 6)
    rows = [json.loads(r.value) for r in spark.read.text(context.output).collect()]
    assert {r["subject"] for r in rows} <= {"Islam", "Buddhism"} and rows
    first = rows[0]
    assert first["domain"] == "religions" and first["aspect"] == "drinks" and first["has_subjects"] == 1 and "[MASK]" in first["masked_sentence"]
    assert 0 < first["combined_score"] <= 1 and first["matches"][0]["text"] in ("Muslim", "Buddhist", "Zen")
    before = context.read(context.where("sentences")).count()
    stages.run(context, 1, 6)  # a rerun changes nothing
    assert context.read(context.where("sentences")).count() == before
    assert sorted(r.value for r in spark.read.text(context.output).collect()) == sorted(json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in rows)


def test_arguments(context):
    for bad in [(0, 1), (3, 2), (1, 7)]:
        with pytest.raises(ValueError):
            stages.run(context, *bad)
    context.facet = None
    with pytest.raises(ValueError):
        stages.run(context, 4)
    assert len(stages.stage_list()) == 6


def test_stream_of_arrivals(spark, context, tmp_path):
    path = str(tmp_path / "stream")
    context.corpus.select("file_path", "doc_i", "text", "url").write.parquet(path)
    query = arrivals(context, spark.readStream.schema("file_path string, doc_i int, text string, url string").parquet(path), str(tmp_path / "check"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(f"{context.where('matches')}_arrivals").drop("batch")
    stages.run(context, 1)
    assert streamed.exceptAll(context.read(context.where("matches"))).count() == 0 and streamed.count() > 0


def test_uniqueness_and_reset(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeats"):
        files.write_collection(df, str(tmp_path / "t"), "k")
    assert files.reset(spark, str(tmp_path / "t")) is False
    df.write.mode("overwrite").parquet(str(tmp_path / "u"))
    assert files.reset(spark, str(tmp_path / "u"), confirm=True) is True


def test_corpus_without_text_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"url": "x"}\n')
    with pytest.raises(Exception):
        files.corpus(spark, str(tmp_path / "bad.json")).collect()


def test_listed_files(spark, tmp_path):
    for k in (1, 2):
        files.write_annotated(spark.range(k).withColumn("text", F.lit("x")), str(tmp_path / f"f{k}"))
    (tmp_path / "list").write_text(f"{tmp_path}/f1\n\n {tmp_path}/f2 \n{tmp_path}/f1\n")
    assert files.file_list(spark, str(tmp_path / "list")).count() == 2
    assert files.listed_files(spark, str(tmp_path / "list")).count() == 3


def test_ids_follow_from_content(spark, tmp_path):
    docs = [{"text": f"t{k % 7}", "url": "u"} for k in range(40)]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, docs)))
    one = sorted((r.doc_i, r.text) for r in files.with_places(files.corpus(spark, str(tmp_path / "c.json"))).collect())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
        many = sorted((r.doc_i, r.text) for r in files.with_places(files.corpus(spark, str(tmp_path / "c.json"))).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one == many and len({d for d, _ in one}) == 40


def test_streams_are_read_by_later_stages(spark, context, tmp_path):
    path = str(tmp_path / "stream")
    context.corpus.select("file_path", "doc_i", "text", "url").write.parquet(path)
    arrivals(context, spark.readStream.schema("file_path string, doc_i int, text string, url string").parquet(path), str(tmp_path / "check")).awaitTermination(120)
    context.corpus = None
    stages.run(context, 3, 6)  # on what the stream has written alone
    rows = [json.loads(r.value) for r in spark.read.text(context.output).collect()]
    assert rows and {r["subject"] for r in rows} <= {"Islam", "Buddhism"}


def test_a_crash_leaves_a_table(spark, context):
    path = context.where("t")
    df = spark.range(3)
    context.replace(df, path)
    files.rename(spark, path, f"{path}.new")  # as if it stopped before the rename
    assert context.exists(path) and context.read(path).count() == 3
    df.write.parquet(f"{path}.new")
    files.delete(spark, f"{path}.new/_SUCCESS")  # as if it stopped while writing
    context.replace(spark.range(5), path)
    assert context.read(path).count() == 5 and not files.exists(spark, f"{path}.new")


def test_places_are_matched_as_entities(spark, tmp_path):
    from dataclasses import replace

    from florilege.config import GEONAMES

    text = "In winter, Finland people are drinking hot coffee in the sauna."
    docs = spark.createDataFrame([(f"d{k}", k, f"{text} Finland people are drinking cold coffee {x}.", f"http://h{k}.org/") for k, x in enumerate(("at home", "at work", "in town"))], "file_path string, doc_i int, text string, url string")
    nodes = spark.createDataFrame([("F", "E", 1, "Finland", "Finland", 5)], "node_id string, parent_id string, level int, name string, short_name string, population bigint")
    aliases = spark.createDataFrame([("finland", "F", 5, 1), ("people", "P", 1, 1)], "alias string, node_id string, population bigint, level int")
    s = replace(GEONAMES, counter_labels=(), excluded_filters=("root-has-nsubj-or-nsubjpass", "remove-present-participle-roots"), min_cluster_size=2, ward_threshold=1.4, diversity=0.1)
    c = stages.Context(spark, str(tmp_path / "t"), s, docs, nodes, aliases, "drink", ["F"], str(tmp_path / "o"), scorer=lexicon_scorer({"drink": ["coffee"]}))
    noted = c.annotator(spark.createDataFrame([("r", text)], "id string, rep string").withColumn("tokens", F.regexp_extract_all("rep", F.lit(stages.TOKEN), F.lit(0))))
    found = stages.mentions(c, noted.select(F.col("id").alias("sentence_id"), "ents"))
    spans = stages.placed(noted.select("id", "rep"), found.withColumnRenamed("sentence_id", "id"), stages.TOKEN).first().spans
    assert [(x.start, x.end, x.text) for x in spans] == [(11, 18, "Finland")]  # people is an alias, but no entity
    stages.run(c, 1, 6)
    rows = [json.loads(r.value) for r in spark.read.text(c.output).collect()]
    assert all("[MASK]" in r["masked_sentence"] and "people" in r["masked_sentence"] for r in rows)
