"""The generic-sentence filter: a registry of named predicates, each a null-safe boolean column.

A predicate sees the columns of an annotated sentence: text, url, toks (array of tokens) and ents (array of
entities). Catalyst may evaluate them in any order, so none relies on another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.config import Settings
from florilege.functions.text import let

Predicate = Callable[[Settings], Column]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _strip() -> Column:
    """Without blanks at the ends, of any kind."""
    return F.regexp_replace(_text(), r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$", "")


def first() -> Column:
    """The first token that isn't blank."""
    return F.get(F.filter(F.col("toks"), lambda t: ~t["is_space"]), F.lit(0))


def root() -> Column:
    """The token that is its own head."""
    return F.get(F.filter(F.col("toks"), lambda t: t["head"] == t["i"]), F.lit(0))


def _any(test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(F.col("toks"), test), F.lit(False))


def _in(value: Column, words: tuple[str, ...]) -> Column:
    return value.isin(*words) if words else F.lit(False)


def _yes(test: Column) -> Column:
    """A test of something that may be missing: then it fails."""
    return F.coalesce(test, F.lit(False))


def _lacks(part: str) -> Predicate:
    return lambda s: ~F.contains(_text(), F.lit(part))


def _count(mark: str) -> Column:
    return F.length(_text()) - F.length(F.replace(_text(), F.lit(mark), F.lit("")))


def _reliable(s: Settings) -> Column:
    url = F.coalesce(F.col("url"), F.lit(""))
    return ~reduce(lambda a, b: a | b, (F.contains(url, F.lit(f".{tail}/")) for tail in s.domain_tails), F.lit(False))


#: Characters that count as digits: decimal digits, and super- and subscripts, circled and other digits.
DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]"

#: The names by which settings refer to rules.
PREDICATES: dict[str, Predicate] = {
    "is-short-enough": lambda s: F.length(_strip()) <= s.max_length,
    "has-at-least-one-token": lambda s: _yes(F.size("toks") >= 1),
    "first-word-is-not-none": lambda s: _yes(F.trim(first()["text"]) != ""),
    "starts-with-capital": lambda s: _yes(first()["text"].rlike(r"^\p{Lu}")),
    "ends-with-period": lambda s: _strip().endswith("."),
    "has-no-bad-first-word": lambda s: _yes(~_in(first()["lower"], s.bad_first_words)),
    "first-word-is-not-verb": lambda s: _yes(first()["pos"] != "VERB"),
    "first-word-is-not-conjunction": lambda s: _yes(~first()["pos"].isin("CCONJ", "SCONJ")),
    "noun-exists-before-root": lambda s: let(root()["i"], lambda r: _any(lambda t: t["pos"].isin("NOUN", "PROPN") & (t["i"] < r))),
    "has-no-digits": lambda s: ~_text().rlike(DIGIT),
    "all-propn-have-acceptable-ne-labels": lambda s: _yes(F.forall(F.coalesce(F.col("ents"), F.expr("array()").cast("array<struct<start:int,end:int,text:string,label:string>>")), lambda e: ~_in(e["label"], s.excluded_entities))),
    "has-no-pronouns": lambda s: ~_any(lambda t: _in(t["lower"], s.pronouns) & (t["pos"] == "PRON")),
    "root-has-nsubj-or-nsubjpass": lambda s: let(root()["i"], lambda r: _any(lambda t: t["dep"].isin("nsubj", "nsubjpass") & (t["head"] == r))),
    "has-no-email": lambda s: ~_any(lambda t: t["like_email"]),
    "dot_dot": _lacks(".."),
    "www": _lacks("www"),
    "com": _lacks("com"),
    "http": _lacks("http"),
    "many_hyphens": lambda s: (_count("-") < 2) & (_count("–") < 2),
    "remove-non-verb-roots": lambda s: _yes(root()["pos"].isin("VERB", "AUX")),
    "remove-first-word-roots": lambda s: _yes(root()["i"] != first()["i"]),
    "remove-present-participle-roots": lambda s: _yes(root()["tag"] != "VBG"),
    "remove-past-tense-roots": lambda s: _yes(root()["tag"] != "VBD"),
    "not-from-unreliable-source": _reliable,
}


def register(name: str, predicate: Predicate) -> None:
    """Add a predicate of one's own, or replace one."""
    PREDICATES[name] = predicate


def verdicts(sentences: DataFrame, settings: Settings) -> DataFrame:
    """sentences with a boolean column for each predicate that the settings don't exclude."""
    return sentences.withColumns({name: p(settings) for name, p in PREDICATES.items() if name not in settings.excluded_filters})


def generic(sentences: DataFrame, settings: Settings) -> DataFrame:
    """sentence_id and is_generic of the sentences that pass all predicates; others have no row."""
    tests = [p(settings) for name, p in PREDICATES.items() if name not in settings.excluded_filters]
    return sentences.filter(reduce(lambda a, b: a & b, tests)).select("sentence_id", F.lit(True).alias("is_generic"))
