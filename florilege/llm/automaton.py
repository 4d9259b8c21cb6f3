"""A BPE merge list compiled into a deterministic automaton over tokens.

Construction (successive merge gadgets). One state, in which every base symbol loops, accepts all symbol
sequences. A merge (u, v) rewrites it so that u is never followed by v but by the new arc u+v:

* all arcs u lead to one state s(u); its copy without the arc v becomes the new s(u);
* every state with an arc u gets an arc u+v, which leads where v led: s(u+v) = s(v).

As each token has a single target state, a state is "what may follow this token", and the automaton accepts
exactly the correct tokenisations. Whether a state has an arc follows from the order of the gadgets: the state of u lacks
v from the merge of (u, v) on; else, if v came after u, v is there if its first part was, then; and if u came after v, u's
state began as that of its second part. `has` follows this down both tokens; no table holds states times tokens.

Over symbols this automaton is made deterministic: a state of the transducer is the set of token arcs that are under
way, each as (state it left, node of the tree of token labels). A symbol moves all of them on at once. Exactly one of them
can end there, as what has been read has one tokenisation; the transition emits its token, and the state that it leads to
joins the set. So a word is one pass from left to right over a table (state, symbol) -> (state, token), and the token at
each place is the last one of the tokenisation up to there: read from the end, they are that of the word. The last symbol
of a word has a word end, which makes it a symbol of its own.

The table is filled where words first lead, from the automaton's own tables, and is emptied when it has MAX_ENTRIES
transitions, so that its size is bounded whatever is read.
"""

from __future__ import annotations

import json
from functools import lru_cache

#: Transitions kept. A word adds one for each symbol at most, so a very long word may exceed it until it ends.
MAX_ENTRIES = 400_000


class Automaton:
    """Tables of the automaton for a vocabulary, its merges in order of rank, and a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.suffix, self.vocab = suffix, vocab
        self.token = {i: t for t, i in vocab.items()}
        self.born: dict[int, int] = {}  # token -> number of merges before it, -1 for base symbols
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}  # the gadgets: pair of tokens -> rank
        made = {a + b for a, b in merges}
        self.size = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in vocab.items()}
        for t, i in vocab.items():
            if t not in made:
                self.born[i] = -1
        for rank, (a, b) in enumerate(merges):
            u, v, uv = vocab.get(a), vocab.get(b), vocab.get(a + b)
            if u is None or v is None or uv is None or uv in self.born or u not in self.born or v not in self.born:
                continue
            if not self.has(u, v):
                continue  # u is never followed by v here: no gadget, and no arc for u+v
            self.born[uv], self.parts[uv], self.merged[u, v] = rank, (u, v), rank
        #: Token -> its state. States are named by a token that leads there, the first one by -1: a token without gadgets of its own
        #: shares the state of its second part, if that part's state is still what it was then.
        last: dict[int, int] = {}
        for (u, _), rank in self.merged.items():
            last[u] = rank
        self.target: dict[int, int] = {}
        for t, rank in self.born.items():
            own = t in last or t in self.parts and last.get(self.parts[t][1], -1) > rank
            self.target[t] = t if own else self.target[self.parts[t][1]] if t in self.parts else -1
        #: The tree of labels: node -> symbol -> node, and the token that ends at a node. A token with the word end is the path of
        #: its symbols, of which the last one has the word end.
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, i in vocab.items():
            if i in self.born and t:
                bare = t.removesuffix(suffix) if suffix else t
                path = [*bare[:-1], bare[-1:] + suffix] if bare != t else list(t)
                node = 0
                for symbol in path:
                    below = self.children[node].get(symbol)
                    if below is None:
                        below = self.children[node][symbol] = len(self.ends)
                        self.children.append({})
                        self.ends.append(-1)
                    node = below
                self.ends[node] = i
        self.forget()

    def has(self, u: int, v: int) -> bool:
        """Whether the state of a token has an arc with another; -1 is the first state, which has all."""
        if u < 0:
            return True
        born, merged, at = self.born, self.merged, 1 << 60
        while True:
            if merged.get((u, v), at) < at:
                return False
            if born[v] >= born[u]:
                if born[v] < 0:
                    return True
                at, v = born[v] + 1, self.parts[v][0]  # with the gadget that made v
            else:
                at, u = born[u], self.parts[u][1]  # before the gadget that made u

    def forget(self) -> None:
        """Empty the table. State 0 is the start: no arc under way but those that leave the automaton's first state."""
        self.table: list[dict[str, tuple[int, int]]] = [{}]
        self.sets: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self.number: dict[tuple[tuple[int, int], ...], int] = {self.sets[0]: 0}
        self.entries = 0

    def _step(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition of a state by a symbol, from the arcs under way: (state, token that ends), or (-1, -1) where none ends."""
        under_way, token, target = [], -1, -1
        for left, node in self.sets[state]:
            below = self.children[node].get(symbol)
            if below is None:
                continue
            if self.children[below]:
                under_way.append((left, below))
            end = self.ends[below]
            if end >= 0 and self.has(left, end):
                token, target = end, self.target[end]
        if token < 0:
            found = (-1, -1)
        else:
            into = tuple(sorted({*under_way, (target, 0)}))
            if into not in self.number:
                self.number[into] = len(self.sets)
                self.sets.append(into)
                self.table.append({})
            found = (self.number[into], token)
        self.table[state][symbol] = found
        self.entries += 1
        return found

    def encode(self, word: str) -> list[int]:
        """The arc labels on the run of a word of base symbols; none for a word with a symbol outside the vocabulary."""
        if not word:
            return []
        if self.entries > MAX_ENTRIES:
            self.forget()
        table, step, state, at = self.table, self._step, 0, []
        for symbol in [*word[:-1], word[-1] + self.suffix]:
            state, token = table[state].get(symbol) or step(state, symbol)
            if state < 0:
                return []
            at.append(token)
        out, k, size = [], len(at), self.size
        while k:
            out.append(at[k - 1])
            k -= size[at[k - 1]]
        return out[::-1]

    def decode(self, ids: list[int]) -> list[str]:
        """The labels of the arcs taken."""
        return [self.token[i] for i in ids]


@lru_cache(maxsize=4)
def compile_file(content: str) -> Automaton:
    model = json.loads(content)["model"]
    return Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
