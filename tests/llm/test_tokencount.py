import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from florilege.llm import tokencount
from florilege.llm.registry import vocabulary

PATH = vocabulary("byte_bpe_50k.tiktoken")
ENCODING, SIZES = tokencount.tokenizer(open(PATH, encoding="ascii").read())


def brute(text):
    """Token by token, character by character."""
    kinds, ends = tokencount.sections(text) if text else ([], [])
    section = [k for k, (a, b) in enumerate(zip([0, *ends], ends)) for _ in range(b - a)]
    character = [k for k, c in enumerate(text) for _ in c.encode()]
    counts, crossing, at = [0] * len(kinds), 0, 0
    for token in ENCODING.encode_ordinary(text):
        size = len(ENCODING.decode_single_token_bytes(token))
        own = [section[c] for c in dict.fromkeys(character[at : at + size])]
        at += size
        counts[max(sorted(set(own)), key=own.count)] += 1
        crossing += len(set(own)) > 1
    return kinds, counts, crossing


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n-\t#é中1.", max_size=60))
def test_attribution(text):
    kinds, counts, crossing = tokencount.counts(text, ENCODING, SIZES)
    assert (kinds, counts.tolist(), crossing) == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(" \n\t\u3000\x85\x1c", max_size=12), st.text("a1'sé中.", max_size=4)), max_size=5), st.integers(2, 5))
def test_cut_runs_are_the_library_s(parts, long):
    """Runs are cut from `long` on instead of LONG: the library can tell that the ids are the same."""
    import re
    from unittest import mock

    text = "".join(a + b for a, b in parts)
    with mock.patch.object(tokencount, "BLANK_RUNS", re.compile(tokencount.BLANK_RUNS.pattern.replace(str(tokencount.LONG), str(long)))):
        assert tokencount.encode(text, ENCODING).tolist() == ENCODING.encode_ordinary(text)


def test_very_long_texts():
    n = 10_000_000
    for text in (" " * n, "\n" * (n // 8), "x" + "\t" * n + "\ty", "a" * n, "中" * (n // 3), "." * n, "a b\n" * (n // 16)):
        kinds, counts, _ = tokencount.counts(text, ENCODING, SIZES)
        assert len(kinds) == len(counts) == text.rstrip("\n").count("\n") + len(text) - len(text.rstrip("\n")) + (not text.endswith("\n")) and counts.sum() > 0


def test_rule_and_kinds():
    kinds, counts, crossing = tokencount.counts("A\n\n\n b\n- c\n", ENCODING, SIZES)
    assert kinds == ["title", "gap", "gap", "body", "list"] and crossing == 1 and counts.sum() == len(ENCODING.encode_ordinary("A\n\n\n b\n- c\n"))


def test_documents(docs, odd, nothing):
    for df in (docs, odd):
        want = sorted((r.doc_id or -1, len(ENCODING.encode_ordinary(r.text or ""))) for r in df.select("doc_id", "text").collect())
        got = tokencount.by_document(df, PATH).collect()
        assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
        assert all(r.n_tokens == sum(r[f"{k}_tokens"] for k in tokencount.KINDS) for r in got)
    per = tokencount.by_section(odd, PATH)
    assert per.agg({"n_tokens": "sum"}).first()[0] == sum(r.n_tokens for r in tokencount.by_document(odd, PATH).collect())
    assert tokencount.by_document(nothing, PATH).count() == 0
    assert isinstance(ENCODING, tiktoken.Encoding)
