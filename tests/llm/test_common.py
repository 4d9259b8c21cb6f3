from pyspark.sql import functions as F

from florilege.llm import common


def test_words_and_text(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \t\x0b ",), ("a  b\n\x0cc\rd",), ("a\xa0b c",)], "t string")
    got = [r.w for r in rows.select(common.words(F.col("t")).alias("w")).collect()]
    assert got == [[], [], [], ["a", "b", "c", "d"], ["a\xa0b", "c"]]


def test_bounded_sample(spark):
    df = spark.range(5000).repartition(7)
    got = {r.id for r in common.bounded_sample(df, 300, "id").collect()}
    assert 250 <= len(got) <= 300
    assert got == {r.id for r in common.bounded_sample(df.repartition(3), 300, "id").collect()}
    assert common.bounded_sample(df, 5000, "id").count() == 5000
    assert common.bounded_sample(df.limit(0), 5, "id").count() == 0


def test_map_rows_runs_after_each_partition(spark, tmp_path):
    mark = str(tmp_path / "done")

    def after():
        with open(mark, "a") as f:
            f.write("x")

    rows = common.map_rows(spark.range(10).repartition(2), lambda c: [[v + 1 for v in c[0]]], "id long", after)
    assert sorted(r.id for r in rows.collect()) == list(range(1, 11))
    assert set(open(mark).read()) == {"x"}
