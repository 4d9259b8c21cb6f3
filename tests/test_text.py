from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from florilege.functions import text as T


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(v for v, _ in cells.values())], ", ".join(f"{k} {t}" for k, (_, t) in cells.items()))
    return row.select(column.alias("x")).first().x


def test_first_word_and_sentence(spark):
    assert value(spark, T.first_word(F.col("w")), w=([" ", "a", "b"], "array<string>")) == "a"
    assert value(spark, T.first_word(F.col("w")), w=([" "], "array<string>")) is None
    assert value(spark, T.first_sentence(F.col("t")), t=("One. Two.", "string")) == "One."


def test_netloc(spark):
    for url, host in [("http://a.b:80/c", "a.b:80"), ("//u@h/x", "u@h"), ("a/b", ""), ("", ""), (None, None)]:
        assert value(spark, T.netloc(F.col("u")), u=(url, "string")) == host


def test_concept_grams_skip_stop_words_and_marks(spark):
    words = ["Rice", "wine", "is", "very", "old", "x2", "tea"]
    assert value(spark, T.concept_grams(F.col("w"), 1), w=(words, "array<string>")) == ["rice", "wine", "old", "tea"]
    assert value(spark, T.concept_grams(F.col("w"), 2), w=(words, "array<string>")) == ["rice wine"]
    assert value(spark, T.concept_grams(F.col("w"), 3), w=(["a"], "array<string>")) == []


def test_without_parts(spark):
    assert value(spark, T.without_parts(F.col("g")), g=(["rice", "rice wine", "price", "wine"], "array<string>")) == ["rice wine", "price"]


def test_plural_aware(spark):
    c = T.plural_aware(F.col("g"), F.col("f"))
    for gram, form, out in [("cats", "cat", "cat"), ("cats", None, "cats"), ("fries", "fry", "fries"), ("cat", "x", "cat")]:
        assert value(spark, c, g=(gram, "string"), f=(form, "string")) == out


def mask(text, spans):
    out, at = "", 0
    for start, end in sorted(spans):
        out += text[at:start] + "[MASK]"
        at = end
    return out + text[at:]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc é", min_size=1, max_size=20), st.lists(st.tuples(st.integers(0, 10), st.integers(0, 10)), max_size=4))
def test_masked_like_python(spark, text, pairs):
    spans = [(min(p), max(p)) for p in pairs]
    got = value(spark, T.masked(F.col("t"), F.col("s")), t=(text, "string"), s=(spans, "array<struct<start:int,end:int>>"))
    assert got == mask(text, spans)


def test_vectors(spark):
    v = ([3.0, 4.0], "array<double>")
    assert value(spark, T.unit(F.col("v")), v=v) == [0.6, 0.8]
    assert value(spark, T.unit(F.col("v")), v=([0.0], "array<double>")) == [None]
    assert value(spark, T.cosine(F.col("v"), F.col("v")), v=v) == 1.0


def test_repair_and_transliteration(spark):
    assert T.mends("cafÃ© &amp; “x” ") == 'café & "x"'
    assert T.mends(None) is None
    assert value(spark, T.transliterated(F.col("t")), t=("Łódź Straße", "string")) == "Lodz Strasse"
    assert value(spark, T.repaired(F.col("t")), t=(" a ", "string")) == "a"


def test_repair_holds_few_texts_at_once():
    import pyarrow as pa

    got = T._sliced(pa.array([f" {k}" if k % 7 else None for k in range(200)]), T.mends)
    assert got.to_pylist() == [str(k) if k % 7 else None for k in range(200)] and T._sliced(pa.array([], pa.string()), T.mends).to_pylist() == []
