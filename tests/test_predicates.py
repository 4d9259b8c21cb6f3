import pytest
from pyspark.sql import functions as F

from florilege.config import OCCUPATIONS, PRESETS, RELIGIONS, Settings, parse_settings, read_settings
from florilege.functions.text import surface
from florilege.operators import annotate, predicates


def verdict(spark, text, settings=PRESETS["geonames"], url=None):
    rows = spark.createDataFrame([("1", text, url)], "sentence_id string, text string, url string")
    rows = annotate.rule_annotator(rows.withColumn("tokens", surface(F.col("text"))))
    return predicates.verdicts(rows, settings).first().asDict()


CASES = [
    ("Rice is good.", "com", True), ("Rice is common.", "com", False), ("A-b and c–d.", "many_hyphens", True), ("A-b-c.", "many_hyphens", False),
    ("Fields cover many km².", "has-no-digits", False), ("Louis Ⅻ rules.", "has-no-digits", True), ("Ⴀ is.", "starts-with-capital", True), ("rice is.", "starts-with-capital", False),
    ("See this..", "dot_dot", False), ("On www here.", "www", False), ("At http here.", "http", False), ("Rice is good. ", "ends-with-period", True), ("Rice", "ends-with-period", False),
    ("This is it.", "has-no-bad-first-word", False), ("x" * 101, "is-short-enough", False), (" " + "x" * 100, "is-short-enough", True), ("", "has-at-least-one-token", False),
    ("", "first-word-is-not-none", False), ("Running is fun.", "first-word-is-not-verb", False), ("And it is.", "first-word-is-not-conjunction", False), ("Rice is good.", "noun-exists-before-root", True),
    ("Is good.", "remove-first-word-roots", False), ("Rice was good.", "remove-past-tense-roots", False), ("Rice growing.", "remove-present-participle-roots", False), ("Rice.", "remove-non-verb-roots", False),
    ("Rice is for you.", "has-no-pronouns", False), ("Rice is good.", "root-has-nsubj-or-nsubjpass", True), ("Rice is good.", "has-no-email", True),
]


@pytest.mark.parametrize("text, name, expected", CASES)
def test_predicate(spark, text, name, expected):
    assert verdict(spark, text)[name] is expected


def test_nulls_never_raise(spark):
    found = verdict(spark, None)
    assert all(v in (True, False) for k, v in found.items() if k in predicates.PREDICATES)


def test_sources_and_exclusions(spark):
    assert verdict(spark, "Rice is.", url="http://a.tk/x")["not-from-unreliable-source"] is False
    assert verdict(spark, "Rice is.", url="http://a.tkx/")["not-from-unreliable-source"] is True
    assert "remove-past-tense-roots" not in verdict(spark, "Rice is.", RELIGIONS)
    assert verdict(spark, "People in Ghana eat.", RELIGIONS)["all-propn-have-acceptable-ne-labels"] is True
    assert verdict(spark, "People in Ghana eat.", OCCUPATIONS)["all-propn-have-acceptable-ne-labels"] is False


def test_registry(spark):
    predicates.register("own", lambda s: F.col("text").startswith("R"))
    try:
        assert verdict(spark, "Rice is.")["own"] is True
    finally:
        del predicates.PREDICATES["own"]


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("people_group: religions\nmax_length: 90\npronouns: [i]\n")
    s = read_settings(path)
    assert (s.max_length, s.pronouns, s.required_labels, s.output_domain) == (90, ("i",), ("religious",), "religions")
    path.write_text("nonsense: 1\n")
    with pytest.raises(ValueError):
        read_settings(path)
    with pytest.raises(ValueError):
        Settings(max_sentences=0)


def test_addresses_of_mail_are_tokens(spark):
    rows = spark.createDataFrame([("Write to joe@mail.org today.",), ("Pay 5 @ noon.",), ("a.b+c@x-y.co.uk",)], "text string")
    got = [r.tokens for r in rows.select(surface(F.col("text")).alias("tokens")).collect()]
    assert got == [["Write", "to", "joe@mail.org", "today", "."], ["Pay", "5", "@", "noon", "."], ["a.b+c@x-y.co.uk"]]
    noted = annotate.rule_annotator(rows.withColumn("tokens", surface(F.col("text"))))
    assert [r[0] for r in noted.select(predicates.PREDICATES["has-no-email"](PRESETS["geonames"])).collect()] == [False, True, False]


def test_nested_settings():
    text = """
occupations: {filepath: x}
candidate_labels: &c [food]
required_true_labels: [food]
pipeline_components:
  generic_sentence_filter: {filter: {is-short-enough: {max_length: 77}}, excluded_filters: [com]}
  representative_generator: {cluster_limit: 9, overwrite: false}
  culture_classifier: {candidate_labels: *c, model: x}
"""
    s = parse_settings(text)
    assert (s.people_group, s.candidate_labels, s.required_labels, s.max_length, s.excluded_filters, s.cluster_limit, s.overwrite_reps, s.overwrite_labels) == ("occupations", ("food",), ("food",), 77, ("com",), 9, False, True)
    with pytest.raises(ValueError):
        parse_settings("no_such: 1")


def test_annotation_is_done_once_by_batches(spark, monkeypatch):
    monkeypatch.setattr(annotate, "TOKENS", 3)
    odd = [None, [], ["Ⴀ", "ing", "A"], ["", "a", None], ["ＡB", "Was", "Jöhn", "a@b.c"], ["Ꟁ", "Ꟁb", "Ᲊing", "5"], ["Rice", "Ghanaians", "eat", "is"]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, tokens array<string>")
    noted = annotate.rule_annotator(rows)
    picked = noted.filter(F.size("toks") > 0).select("k", F.transform("toks", lambda t: t["pos"]).alias("p"), F.col("toks")[0]["head"].alias("root"), F.size("ents").alias("n"))
    assert picked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.k: (r.p, r.root, r.n) for r in picked.collect()}
    assert got == {
        2: (["NOUN", "NOUN", "DET"], 0, 0), 3: (["PUNCT", "DET", "NOUN"], 0, 0), 4: (["NOUN", "AUX", "PROPN", "NOUN"], 1, 1),
        5: (["PUNCT", "NOUN", "NOUN", "NUM"], 0, 0), 6: (["NOUN", "PROPN", "NOUN", "AUX"], 3, 1),
    }
    assert [r.toks for r in noted.filter("k < 2").orderBy("k").collect()] == [None, []]
