"""Annotation: sentences and tokens, and the providers of what needs a model.

A provider is any function with the signature of its stand-in here. The stand-ins are rules, deterministic and
offline; they are no substitute in quality for a parser, an entailment model, a sentence encoder or a summariser.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from florilege.functions.text import TOKEN, repaired, sentences, surface, unit
from florilege.runtime import prepare

#: The closed word classes of the rule tagger.
CLASSES = {
    "PRON": "i me my we us our you your he him his she her it its they them their who",
    "DET": "the a an this that these those each every no some any all both",
    "CCONJ": "and or but nor",
    "SCONJ": "if because as while until than",
    "ADP": "of in on by with for from at to into through about between",
    "AUX": "is are was were be been am has have had do does did will can may must should would could",
    "ADV": "not often usually always also very",
}
PAST = ("was", "were", "had", "did", "been")

Annotator = Callable[[DataFrame], DataFrame]


def sentence_rows(docs: DataFrame, repair: bool = False) -> DataFrame:
    """Rows of sentences from documents with file_path, doc_i, text and url: ids follow from the place, so that reruns agree.

    `raw` is the sentence as it stands, `text` the stored one, trimmed (and repaired on request)."""
    rows = docs.select("file_path", "doc_i", "url", F.posexplode(sentences(F.col("text"))).alias("sent_i", "raw"))
    text = repaired(F.col("raw")) if repair else F.trim("raw")
    key = F.concat_ws(":", "file_path", "doc_i", "sent_i")
    return rows.select(F.substring(F.sha2(key, 256), 1, 24).alias("sentence_id"), "file_path", "doc_i", "sent_i", text.alias("text"), surface(F.col("raw")).alias("tokens"), "url", "raw")


def leading(text: Column) -> Column:
    """The first token alone, as toks: all that rules on plain text look at, so that they need no annotation."""
    word = F.regexp_extract(text, TOKEN, 0)
    only = F.struct(F.lit(0).alias("i"), word.alias("text"), F.lower(word).alias("lower"), F.lit(False).alias("is_space"))
    return F.when(word == "", F.array().cast("array<struct<i:int,text:string,lower:string,is_space:boolean>>")).otherwise(F.array(only))


#: Beyond these characters Python's version of Unicode and the JVM's may differ; there the JVM says what is a letter and what is lower case.
ODD = r"[^\x{0}-\x{86F}\x{2000}-\x{206F}\x{20A0}-\x{20BF}\x{3000}-\x{9FEF}\x{AC00}-\x{D7A3}]"
WORDS = {word: pos for pos, listed in reversed(CLASSES.items()) for word in listed.split()}
END = "(?:\r\n|[\n\r\x85\u2028\u2029])?"
NUMBER, PARTICIPLE, PEOPLE, ADDRESS = re.compile(f"[0-9]+{END}"), re.compile(rf"(?:ing|ed){END}\Z"), re.compile(rf"(?:ans?|ese|ish){END}\Z"), re.compile(r"[\w.+-]+@[\w-]+\.\w", re.ASCII)
NOTES = "toks array<struct<i:int,text:string,lower:string,pos:string,tag:string,dep:string,head:int,is_space:boolean,like_email:boolean>>, ents array<struct<start:int,end:int,text:string,label:string>>"
#: Tokens that a worker annotates at once, but for a longer row.
TOKENS = 1 << 18


def _notes(text: str | None, lower: str | None, worded: bool, capital: bool, first: bool) -> tuple:
    """lower, pos, tag, is_space, like_email and label of a token, as a sentence's first or later one."""
    if text is None:
        return None, "NOUN", "NOUN", None, None, "GPE"
    if not worded:
        pos = "PUNCT"
    elif NUMBER.fullmatch(lower):
        pos = "NUM"
    else:
        pos = WORDS.get(lower) or ("VERB" if len(lower) > 4 and PARTICIPLE.search(lower) else "PROPN" if capital and not first else "NOUN")
    tag = "VBD" if lower in PAST else "VBG" if pos == "VERB" and lower.endswith("ing") else "VBD" if pos == "VERB" and lower.endswith("ed") else "VBZ" if pos == "AUX" else pos
    return lower, pos, tag, not text.strip(" "), bool(ADDRESS.match(text)), "NORP" if PEOPLE.search(lower) else "GPE"


@lru_cache(1 << 17)
def _plain(text: str | None, first: bool) -> tuple:
    return _notes(text, text and text.lower(), any(unicodedata.category(c)[0] in "LN" for c in text or ""), unicodedata.category((text or " ")[0]) == "Lu", first)


def _annotated(tokens: pa.Array, odd: pa.Array) -> tuple[pa.Array, pa.Array]:
    """toks and ents of rows of tokens; odd has lower, worded and capital of the tokens of rows with characters that the JVM decides on."""
    n, length = len(tokens), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(length)
    text = tokens.flatten()
    row = np.repeat(np.arange(n), length)
    i = np.arange(len(text)) - np.repeat(ends - length, length)
    coded = text.dictionary_encode()
    word = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    seen = [*coded.dictionary.to_pylist(), None]
    known = [_plain(t, first) for first in (False, True) for t in seen]
    at = word + len(seen) * (i == 0)
    for r in np.flatnonzero(odd.is_valid().to_numpy(zero_copy_only=False)):
        for k, x in enumerate(odd[int(r)].as_py()):
            place = int(ends[r] - length[r]) + k
            at[place] = len(known)
            known.append(_notes(seen[word[place]], x["lower"], x["worded"], x["capital"], k == 0))
    lower, pos, tag, space, address, label = zip(*known)
    among = lambda *listed: np.fromiter((p in listed for p in pos), bool, len(pos))
    root, subject = np.zeros(n, np.int64), np.full(n, -1)
    found = np.flatnonzero(among("AUX", "VERB")[at])[::-1]
    root[row[found]] = i[found]  # the first, which is written last
    found = np.flatnonzero(among("NOUN", "PROPN", "PRON")[at] & (i < root[row]))
    subject[row[found]] = i[found]
    dep = np.where(i == root[row], 0, np.where(i == subject[row], 1, 2))
    take = lambda values, kind, places: pa.array(values, kind).take(pa.array(places))
    whole = lambda x: pa.array(x, pa.int32())
    fields = {"i": whole(i), "text": text, "lower": take(lower, pa.string(), at), "pos": take(pos, pa.string(), at), "tag": take(tag, pa.string(), at), "dep": take(["ROOT", "nsubj", "dep"], pa.string(), dep)}
    fields |= {"head": whole(root[row]), "is_space": take(space, pa.bool_(), at), "like_email": take(address, pa.bool_(), at)}
    name = np.flatnonzero(among("PROPN")[at])
    names = {"start": whole(i[name]), "end": whole(i[name] + 1), "text": text.take(pa.array(name)), "label": take(label, pa.string(), at[name])}
    listed = lambda x, upto: pa.ListArray.from_arrays(whole(np.concatenate([[0], upto])), pa.StructArray.from_arrays(list(x.values()), list(x)), mask=tokens.is_null())
    return listed(fields, ends), listed(names, np.cumsum(np.bincount(row[name], minlength=n)))


def rule_annotator(rows: DataFrame) -> DataFrame:
    """toks and ents for rows with tokens. The root is the first auxiliary or verb, else the first token; the last noun
    or pronoun before it is its subject; all tokens hang from the root. Capitals within a sentence are entities.

    By Arrow batches, where each distinct token is looked at once; what reads toks doesn't annotate again."""
    prepare(rows.sparkSession)
    says = F.transform("tokens", lambda t: F.struct(F.lower(t).alias("lower"), t.rlike(r"[\p{L}\p{N}]").alias("worded"), t.rlike(r"^\p{Lu}").alias("capital")))
    shape = StructType([f for f in rows.schema if f.name not in ("toks", "ents")] + list(_parse_datatype_string(NOTES)))
    kept = [f.name for f in shape][:-2]
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            upto = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = upto[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, before + TOKENS, "right")))
                part = batch.slice(lo, hi - lo)
                notes = _annotated(part.column("tokens"), part.column("_odd"))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*(part.column(k) for k in range(len(kept))), *notes], arrow)], schema=arrow)
                lo = hi
        pa.default_memory_pool().release_unused()

    return rows.select(*[F.col(f"`{k}`") for k in kept], F.when(F.array_join("tokens", "").rlike(ODD), says).alias("_odd")).mapInArrow(run, shape)


def lexicon_scorer(lexicons: dict[str, list[str]]) -> Callable[[DataFrame], DataFrame]:
    """A scorer: sentence_id and scores, for each label the share n / (n + 1) of its n words in the sentence; labels are scored independently."""

    def score(rows: DataFrame) -> DataFrame:
        lower = F.transform("tokens", F.lower)
        count = lambda words: F.size(F.filter(lower, lambda t: t.isin(*words)))
        values = [count(words) for words in lexicons.values()]
        scores = F.map_from_arrays(F.array(*[F.lit(k) for k in lexicons]), F.array(*[(v / (v + 1)).cast("double") for v in values]))
        return rows.select("sentence_id", scores.alias("scores"))

    return score


def hashed_encoder(rows: DataFrame, text_col: str = "text", size: int = 64) -> DataFrame:
    """rows with `embedding`: counts of tokens by hash with signs, over their length."""
    words = F.transform(surface(F.lower(F.col(text_col))), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("k"), F.when(F.hash(t) % 2 == 0, 1.0).otherwise(-1.0).alias("v")))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(w["k"] == k, w["v"]).otherwise(0.0)))
    return rows.withColumn("embedding", unit(cells))
