"""Providers that run real models: adapters from a function that loads a model to the signatures of operators.annotate.

A loader runs once a worker process, where the model then stays; rows reach it by Arrow, in batches of `size` texts. What a
loader returns is plain Python: a parser gives for each text its tokens and entities, a classifier for each text a score of
each label, an encoder for each text a vector, a summariser for a prompt a sentence. The package needs none of the libraries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege import schemas
from florilege.runtime import prepare

BATCH = 32
Texts = Sequence[str]

_LOADED: dict[str, object] = {}


def _model(key: str, load: Callable[[], Callable]) -> Callable:
    """The worker's model of a loader; each task has its own copy of the loader, so the model goes by the loader's content."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def _in_batches(texts: list[str], run: Callable[[Texts], Sequence], size: int) -> list:
    out: list = []
    for k in range(0, len(texts), size):
        got = list(run(texts[k : k + size]))
        if len(got) != len(texts[k : k + size]):
            raise ValueError("a model must give one result for each text")
        out += got
    return out


def _mapped(rows: DataFrame, column: str, ddl: str, load: Callable[[], Callable], shape: Callable[[object], dict], size: int, keep: list[str]) -> DataFrame:
    """keep's columns and what shape makes of the model's result for each text of a column; a null text is an empty one."""
    prepare(rows.sparkSession)
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()
    schema = rows.select(*keep).schema
    made = rows.sparkSession.createDataFrame([], ddl).schema
    for field in made:
        schema = schema.add(field)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, load)
        for part in parts:
            got = [shape(g) for g in _in_batches(part.pop("_text").fillna("").tolist(), model, size)]
            yield part.assign(**{f.name: [g[f.name] for g in got] for f in made})

    return rows.select(*keep, F.col(column).alias("_text")).mapInPandas(run, schema)


def parser(load: Callable[[], Callable[[Texts], Sequence]], column: str = "raw", size: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """An annotator: rows with toks and ents from a parser. For each text it gives (tokens, entities), as dictionaries of the fields of schemas.TOKEN and ENTITY."""

    def annotate(rows: DataFrame) -> DataFrame:
        text = column if column in rows.columns else "text"
        ddl = f"toks array<{schemas.TOKEN}>, ents array<{schemas.ENTITY}>"
        keep = [c for c in rows.columns if c not in ("toks", "ents")]
        return _mapped(rows, text, ddl, load, lambda g: {"toks": list(g[0]), "ents": list(g[1])}, size, keep)

    return annotate


def classifier(load: Callable[[], Callable[[Texts, Sequence[str]], Sequence]], labels: Sequence[str], size: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A scorer: sentence_id and scores by label, each label scored for itself (a model that scores several labels at once isn't normalised over them)."""
    labels = tuple(labels)

    def score(rows: DataFrame) -> DataFrame:
        bound = lambda: (lambda model: lambda texts: model(texts, labels))(load())
        shape = lambda g: {"scores": {k: float(v) for k, v in zip(labels, g, strict=True)}}
        return _mapped(rows, "text", "scores map<string,double>", bound, shape, size, ["sentence_id"])

    return score


def encoder(load: Callable[[], Callable[[Texts], Sequence]], size: int = BATCH) -> Callable[..., DataFrame]:
    """An encoder: rows with `embedding`, the model's vector of the text over its length (the zero vector stays)."""

    def unit(vector: Sequence[float]) -> dict:
        length = sum(float(x) ** 2 for x in vector) ** 0.5 or 1.0
        return {"embedding": [float(x) / length for x in vector]}

    def encode(rows: DataFrame, text_col: str = "text") -> DataFrame:
        keep = [c for c in rows.columns if c != "embedding"]
        return _mapped(rows, text_col, "embedding array<double>", load, unit, size, keep)

    return encode


def summariser(load: Callable[[], Callable[[Texts], Sequence[str]]], size: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A summariser of prompts, for clusters of three texts or more: from rows with prompt, rows with rep."""

    def summarise(rows: DataFrame) -> DataFrame:
        return _mapped(rows, "prompt", "rep string", load, lambda g: {"rep": str(g)}, size, [c for c in rows.columns if c != "prompt"])

    return summarise
