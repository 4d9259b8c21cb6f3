"""Token counts of a document's sections, by attribution of the tokens of the whole document.

A document is encoded once, whole, so that counts add up to what a model would see. Its tokens' character spans are
joined with the spans of its sections, and each token counts for one section. A token's span runs from the character
of its first byte to that of its last one, so tokens that are parts of a character have that character as span.

Sections are the document's lines, each with its line end; they cover the document without gaps. The first line
that holds a word is the title, lines that start with `-`, `*`, `#` or `|` are lists, blank lines are gaps, all
others are body.

A token that crosses a boundary counts for the section that holds most of its characters, and for the earliest of
these on a tie.

Null and empty texts have no tokens and no sections. Texts may be of any length, and so may their runs of blanks: the
library's matcher gives up on runs of about a million, so runs of LONG or more are cut here, where its pattern cuts them.
A row needs a few dozen times its own bytes. Null ids and repeated rows are rows like any other, and equal texts get
equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import BLANKS, map_rows

#: White space of the tokenizer's pattern (Unicode's), and the length from which a run of it is cut here.
LONG = 10_000
BLANK_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)
KINDS = ("title", "body", "list", "gap")
#: Fixed by the tokenizer: the pattern that cuts a text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(content: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file's content, and the number of bytes of each token."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(text: str, encoding: tiktoken.Encoding) -> np.ndarray:
    """The token ids of a text. A run of blanks is one piece, but for its last one where a word follows."""
    out, start = [], 0
    for run in BLANK_RUNS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out.append(encoding.encode_to_numpy(text[start : run.start()], disallowed_special=()))
        out.append(np.array(encoding._encode_single_piece(text[run.start() : end]), np.uint32))
        start = end
    out.append(encoding.encode_to_numpy(text[start:], disallowed_special=()))
    return np.concatenate(out) if len(out) > 1 else out[0]


def sections(text: str) -> tuple[list[str], np.ndarray]:
    """The kind of each section, and the character offset of each end."""
    kinds, sizes, titled = [], [], False
    for line in text.split("\n"):
        bare = line.strip(BLANKS)
        kind = "gap" if not bare else "title" if not titled else "list" if bare[0] in "-*#|" else "body"
        titled = titled or bool(bare)
        kinds.append(kind)
        sizes.append(len(line) + 1)
    sizes[-1] -= 1
    return (kinds, np.cumsum(sizes)) if sizes[-1] else (kinds[:-1], np.cumsum(sizes[:-1]))


def spans(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end in characters of tokens of so many bytes each."""
    starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # the characters that begin up to each byte
    ends = np.cumsum(sizes)
    return starts[ends - sizes] - 1, starts[ends - 1]


def attribute(ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary; from the ends of sections and the spans of tokens."""
    first = np.searchsorted(ends, begin, side="right")
    last = np.searchsorted(ends, end - 1, side="right")
    crosses, best = first != last, first.copy()
    if crosses.any():
        own, begin, end, n = first[crosses], begin[crosses], end[crosses], (last - first + 1)[crosses]
        at = np.cumsum(n) - n  # where each token's sections begin in a list of all of them
        own = np.arange(n.sum()) + np.repeat(own - at, n)
        held = np.minimum(ends[own], np.repeat(end, n)) - np.maximum(np.where(own > 0, ends[own - 1], 0), np.repeat(begin, n))
        most = held == np.repeat(np.maximum.reduceat(held, at), n)
        best[crosses] = np.minimum.reduceat(np.where(most, own, len(ends)), at)
    return best, crosses


def counts(text: str | None, encoding: tiktoken.Encoding, sizes: np.ndarray) -> tuple[list[str], np.ndarray, int]:
    """Kinds of the sections, their tokens, and how many tokens cross a boundary."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [], np.zeros(0, np.int64), 0
    text = raw.decode("utf-8")
    kinds, ends = sections(text)
    best, crosses = attribute(ends, *spans(raw, sizes[encode(text, encoding)]))
    return kinds, np.bincount(best, minlength=len(kinds)), int(crosses.sum())


def _load(df: DataFrame, path: str):
    with open(path, encoding="ascii") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: its size does not depend on the data


def by_section(df: DataFrame, path: str) -> DataFrame:
    """A row for each section: doc_id, section (from 0), kind, n_tokens."""
    content = _load(df, path)

    def run(columns: list[list]) -> list[list]:
        encoding, sizes = tokenizer(content.value)
        got = [counts(t, encoding, sizes) for t in columns[1]]
        return [columns[0], [[(k, int(n)) for k, n in zip(g[0], g[1])] for g in got]]

    rows = map_rows(df.select("doc_id", "text"), run, "doc_id long, sections array<struct<kind:string,n_tokens:long>>")
    return rows.select("doc_id", F.posexplode("sections").alias("section", "s")).select("doc_id", "section", "s.kind", "s.n_tokens")


def by_document(df: DataFrame, path: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, n_sections, n_crossing, and the tokens of each kind of section."""
    content = _load(df, path)

    def run(columns: list[list]) -> list[list]:
        encoding, sizes = tokenizer(content.value)
        out: list[list] = [[] for _ in range(4 + len(KINDS))]
        for doc, text in zip(*columns):
            kinds, per, crossing = counts(text, encoding, sizes)
            sums = dict.fromkeys(KINDS, 0)
            for kind, n in zip(kinds, per.tolist()):
                sums[kind] += n
            for column, value in zip(out, (doc, sum(sums.values()), len(kinds), crossing, *sums.values())):
                column.append(value)
        return out

    return map_rows(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, n_sections long, n_crossing long, " + ", ".join(f"{k}_tokens long" for k in KINDS))
