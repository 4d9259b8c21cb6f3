"""Scalar functions on text, tokens, vectors and spans, as columns."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that are part of no concept.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def sentences(text: Column) -> Column:
    """Pieces of a text that end with . ! or ? before white space; null text has none."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")


def first_sentence(text: Column) -> Column:
    """The first sentence, or the text if there is none."""
    return F.coalesce(F.nullif(F.get(sentences(text), F.lit(0)), F.lit("")), text)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: A token as it stands: an address of mail, a run of letters and digits, or a single other mark. A local part has 64 characters at most.
TOKEN = r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def surface(text: Column) -> Column:
    """The tokens of a text, as they stand."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def first_word(words: Column) -> Column:
    """The first token that isn't blank; null if there is none."""
    return F.get(F.filter(words, lambda t: F.trim(t) != ""), F.lit(0))


def netloc(url: Column) -> Column:
    """Host, port and user of a URL; '' where it has none, null for null."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def grams(words: Column, n: int) -> Column:
    """All windows of n tokens, joined by blanks."""
    window = lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - n), window))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def concept_grams(words: Column, n: int) -> Column:
    """Distinct windows of n tokens that are letters only and hold no stop word, in lower case."""

    def windows(marked: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(marked) - n), lambda i: F.slice(marked, i + 1, F.lit(n)))
        found = F.filter(each, lambda w: F.forall(w, F.isnotnull))
        return F.when(F.size(marked) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(found, lambda w: F.array_join(w, " "))))

    lower = F.transform(words, F.lower)
    return let(F.transform(lower, lambda t: F.when(t.rlike(r"^\p{L}+$") & ~t.isin(*STOP_WORDS), t)), windows)


def within(short: Column, long: Column) -> Column:
    """Whether a gram is part of another at word boundaries; both are tokens joined by blanks."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.contains(pad(long), pad(short))


def without_parts(found: Column) -> Column:
    """The grams that are no word-bounded part of a gram with more tokens."""
    count = lambda g: F.size(F.split(g, " "))
    return F.filter(found, lambda s: ~F.exists(found, lambda g: (count(s) < count(g)) & within(s, g)))


def plural_aware(gram: Column, form_of: Column) -> Column:
    """A gram's base form where it ends in s, isn't an exception and has one; form_of is the looked-up form or null."""
    return F.when(gram.endswith("s") & (gram != "fries"), F.coalesce(form_of, gram)).otherwise(gram)


def masked(text: Column, spans: Column, token: str = "[MASK]") -> Column:
    """A text with spans (array of structs start, end, in characters) replaced in order of start.

    The cursor moves to each span's end, also back: overlapping spans each leave a token."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        piece = F.when(span["start"] > state["at"], F.substring(text, state["at"] + 1, span["start"] - state["at"])).otherwise("")
        return F.struct(F.concat(state["out"], piece, F.lit(token)).alias("out"), span["end"].cast("int").alias("at"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def score_map(labels: Column, scores: Column) -> Column:
    return F.map_from_arrays(labels, scores)


def noun_density(toks: Column) -> Column:
    """(nouns + 1) / (tokens + 1); proper nouns don't count."""
    return (F.size(F.filter(toks, lambda t: t["pos"] == "NOUN")) + 1) / (F.size(toks) + 1)


def aspect(facet: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return facet
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, facet), facet)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length; nulls for the zero vector."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), length))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def round_robin(position: Column, n: int) -> Column:
    return F.pmod(position, F.lit(n))


def _once(found: re.Match[str]) -> str:
    """A run of characters as the UTF-8 that it was read from, if it is that."""
    try:
        return found[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return found[0]


def mends(text: str | None) -> str | None:
    """A text with character references resolved, one layer of UTF-8 read as Windows-1252 undone, quotes straightened,
    control characters gone, in NFC, without blanks at its ends."""
    if text is None:
        return None
    out = html.unescape(text) if "<" not in text else text
    out = re.sub("[Â-ô][^\x00-\x7f]{1,3}", _once, out)
    out = out.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0xFB01: "fi", 0xFB02: "fl", 0xFEFF: None})
    out = "".join(c for c in out if c in "\t\n\r" or unicodedata.category(c) != "Cc")
    return unicodedata.normalize("NFC", out).strip()


#: Texts that a worker turns into Python's strings at once; a batch holds up to 10,000.
SLICE = 64


def _sliced(texts: pa.Array, function: Callable[[str | None], str | None]) -> pa.Array:
    parts = [pa.array([function(t) for t in texts.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def repaired(text: pa.Array) -> pa.Array:
    return _sliced(text, mends)


#: Letters that have no decomposition, and their usual spelling in ASCII.
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"}


def transliterated(text: Column) -> Column:
    """Latin text in ASCII: letters lose their marks; what has no spelling is dropped."""
    return _ascii(text)


@F.arrow_udf(StringType())
def _ascii(text: pa.Array) -> pa.Array:
    table = str.maketrans(SPELLED)
    plain = lambda t: None if t is None else unicodedata.normalize("NFKD", t.translate(table)).encode("ascii", "ignore").decode()
    return _sliced(text, plain)
