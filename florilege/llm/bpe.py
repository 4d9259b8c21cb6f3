"""BPE encoding and decoding by the automaton of `automaton`.

Whole texts are normalised and cut by the tokenizer's split pattern; each distinct piece is run through the
automaton when a worker first meets it, and looked up after that.

Nulls and empty or blank texts have no tokens, and decode to the empty text. Texts and their pieces may be of any
length. Repeated rows and null ids are rows like any other, and equal texts get equal results. An empty table gives an
empty result. Other columns, of whatever names, are ignored. The memory of a worker is bounded: it keeps the
pieces met last, of LONGEST characters at most each, in two tables of MAX_PIECES at most, and the automaton's table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from florilege.llm.automaton import Automaton, compile_file
from florilege.llm.common import map_rows

MAX_PIECES = 200_000
#: Longer pieces are encoded each time.
LONGEST = 64

#: Fixed by the tokenizer: how it cuts words, and which code points stand for bytes.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable code point of each byte: its own where it prints in Latin-1, else the next from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4096)
def unassigned(c: str) -> bool:
    """Whether Python's Unicode version lacks a code point. The library's may be newer, with letters and pairs of case there."""
    return unicodedata.category(c) == "Cn"


class Encoder:
    """Pre-split word -> (ids joined by spaces, labels joined by spaces, number of tokens), by look-up where known."""

    def __init__(self, automaton: Automaton, added: dict[str, int], content: str) -> None:
        self.automaton, self.added, self.content = automaton, added, content
        self.library: Tokenizer | None = None
        self.symbols = byte_symbols()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}

    def ids(self, piece: str) -> list[int]:
        same = piece.isascii() and piece.isprintable()  # bytes that stand for themselves; no piece holds a space
        return self.automaton.encode(piece if same else "".join([self.symbols[b] for b in piece.encode("utf-8", "replace")]))

    def _joined(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), " ".join(self.automaton.decode(ids)), len(ids)

    def piece(self, piece: str) -> tuple[str, str, int]:
        got = self.older.get(piece) or self._joined(self.ids(piece))
        if len(piece) <= LONGEST:
            if len(self.known) >= MAX_PIECES:
                self.older, self.known = self.known, {}
            self.known[piece] = got
        return got

    def pieces(self, part: str) -> list[tuple[str, str, int]]:
        """What is between added tokens: normalised (lower case by code point: no final sigma), cut, and encoded."""
        if not part.isascii() and any(map(unassigned, set(part))):
            # Only the library knows its Unicode version: it normalises and cuts these texts, the automaton encodes them.
            self.library = library = self.library or Tokenizer.from_str(self.content)
            return [self._joined(self.automaton.encode(p)) for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))]
        known, piece = self.known, self.piece
        return [known.get(c) or piece(c) for c in SPLIT.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())]

    def forget(self) -> None:
        self.known, self.older = {}, {}
        self.automaton.forget()

    def text(self, text: str | None) -> tuple[str, str, int]:
        """Added tokens stay whole; what is between them is cut and encoded."""
        text = text or ""
        got: list[tuple[str, str, int]] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and any(t in text for t in self.added) else [text]):
            got += [(str(self.added[part]), part, 1)] if k % 2 else self.pieces(part)
        return " ".join([v[0] for v in got]), " ".join([v[1] for v in got]), sum([v[2] for v in got])


_ENCODERS: dict[int, Encoder] = {}


def encoder(content: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content; compiled once."""
    key = hash(content)
    if key not in _ENCODERS:
        added = {t["content"]: t["id"] for t in json.loads(content).get("added_tokens", [])}
        _ENCODERS[key] = Encoder(compile_file(content), added, content)
    return _ENCODERS[key]


def _load(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: its size does not depend on the data


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and decoded text of each row."""
    content = _load(df, path)

    def run(columns: list[list]) -> list[list]:
        coder = encoder(content.value)
        got = [coder.text(t) for t in columns[1]]
        return [columns[0], [[int(i) for i in g[0].split()] for g in got], [g[1] for g in got]]

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return map_rows(df.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(df: DataFrame, path: str, release: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of documents. With release, workers drop their tables at the
    end of each partition: slower, but other stages that share the executors have the memory."""
    content = _load(df, path)

    def run(columns: list[list]) -> list[list]:
        coder, sha = encoder(content.value), hashlib.sha256
        got = [coder.text(t) for t in columns[1]]
        return [columns[0], [g[2] for g in got], [sha(g[0].encode()).hexdigest() for g in got], [sha(g[1].encode()).hexdigest() for g in got]]

    return map_rows(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", (lambda: encoder(content.value).forget()) if release else None)
