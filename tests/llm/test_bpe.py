import hashlib

import pytest
from tokenizers import Tokenizer

from florilege.llm import bpe
from florilege.llm.automaton import Automaton
from florilege.llm.registry import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_equals_the_library(request, library, table):
    df = request.getfixturevalue(table)
    want = sorted((r.doc_id or -1, *expected(library, r.text)) for r in df.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect()) == want


def test_hard_texts(library):
    coder = bpe.encoder(open(PATH, encoding="utf-8").read())
    for text in ["ΑΣ ΑΣ. Σ", "İstanbul ǅ ﬁ Ⅻ ²³", "a<|endoftext|>b<|startoftext|>", "é é", "a\x1cb c\x85d\xa0e", "don't I'LL ''S 12ab34", "a" * 3000, "!" * 500, "\x00\x7f"]:
        ids, decoded, n = coder.text(text)
        got = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == got and n == len(got)
        assert decoded == library.decode(got, skip_special_tokens=False)


def greedy(word, merges):
    """Merges by rank, each at all places from the left."""
    parts = list(word)
    for a, b in merges:
        k = 0
        while k < len(parts) - 1:
            if (parts[k], parts[k + 1]) == (a, b):
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


def test_automaton_is_merging_by_rank():
    import itertools

    for merges in ([("a", "b"), ("b", "a"), ("ab", "a")], [("a", "a"), ("aa", "a"), ("b", "aa")], [("b", "c"), ("a", "b"), ("a", "bc"), ("c", "abc")]):
        vocab = {t: i for i, t in enumerate(["a", "b", "c", *dict.fromkeys(a + b for a, b in merges)])}
        automaton = Automaton(vocab, merges)
        for n in range(1, 8):
            for word in map("".join, itertools.product("abc", repeat=n)):
                assert automaton.decode(automaton.encode(word)) == greedy(word, merges)
        assert automaton.encode("") == []


def test_real_ids_and_empty_table(spark, odd, nothing):
    rows = bpe.encode(odd, PATH).collect()
    assert len(rows) == odd.count() and all(len(r.ids) > 0 for r in rows if r.doc_id == 5)
    assert bpe.digests(nothing, PATH).count() == 0


def test_every_code_point_and_random_texts(library):
    """Also letters of newer Unicode versions: alone, between letters and after a mark."""
    import random

    coder = bpe.encoder(open(PATH, encoding="utf-8").read())
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    known = [c for c in points if not bpe.unassigned(c)]
    texts = [" ".join(known[k : k + 500]) for k in range(0, len(known), 500)] + [" ".join(f"a{c}b" for c in known[k : k + 500]) for k in range(0, len(known), 500)]
    texts += [f"a{c}b {c}" for c in sorted({*points[:0x20000]} - {*known})[::50]] + ["A\u1c89b \ua7cb1"]
    texts += ["".join(rng.choices(points[:0x20000], k=60)) for _ in range(300)]
    for text, got in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids, decoded, n = coder.text(text)
        assert [int(i) for i in ids.split()] == got.ids, [c for c in text.split(" ") if [int(i) for i in coder.text(c)[0].split()] != library.encode(c, add_special_tokens=False).ids][:10]


def test_one_pass_and_bounded_tables(library):
    from florilege.llm import automaton

    coder = bpe.encoder(open(PATH, encoding="utf-8").read())
    coder.forget()
    small = automaton.MAX_ENTRIES
    automaton.MAX_ENTRIES = 300
    try:
        for word in ["internationalisation", "zzzqqqxxyyzz" * 20, "pneumonoultramicroscopic", "a" * 999, "ab" * 5000] * 2:
            assert coder.ids(word) == library.encode(word, add_special_tokens=False).ids
            assert len(coder.automaton.sets) <= coder.automaton.entries + 1
    finally:
        automaton.MAX_ENTRIES = small
    long = "中文字" * 400_000  # one piece: encoded, not kept
    assert coder.text(long)[2] == len(library.encode(long, add_special_tokens=False).ids)
    assert max(map(len, coder.known), default=0) <= bpe.LONGEST
