import random

import numpy as np
import pytest
import xxhash

from florilege.llm import simhash


def slow(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[k : k + 4]) for k in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """Groups of linked fingerprints, by their first index."""
    owner = list(range(len(prints)))

    def root(k):
        while owner[k] != k:
            k = owner[k]
        return k

    x = np.array(prints, np.uint64)
    for i, j in np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4):
        a, b = root(i), root(j)
        owner[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(prints))]


def family(seed, centres, copies, flips=4):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.add(c)
        for _ in range(copies):
            x = c
            for _ in range(rng.randint(1, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed, centres, copies", [(1, 60, 20), (2, 3, 500), (3, 800, 1)])
def test_trie_join_is_brute_force(seed, centres, copies, monkeypatch):
    prints = family(seed, centres, copies)
    for chunk in (50, 200_000):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        label = simhash.trie_self_join(np.array(prints, np.uint64), np.array([0, len(prints)]))
        assert label.tolist() == brute(prints)


@pytest.mark.parametrize("blocks, hot", [(5, 100_000), (6, 100_000), (7, 100_000), (5, 6), (6, 0)])
def test_forest_over_all_tries(spark, monkeypatch, blocks, hot):
    prints = family(blocks, 40, 12)
    monkeypatch.setattr(simhash, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "GATHER", 100)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {r.fp: r.root for r in simhash.components(simhash.forest(df, len(prints))).collect()}
    own = [got.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    want = brute(prints)
    assert len({*zip(own, want)}) == len(set(want)) == len(set(own))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_groups(request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    prints = [slow(r.text) for r in rows]
    least = {}
    roots = brute(prints)
    for r, g in zip(rows, roots):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((r.doc_id, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, roots)), key=key)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(df).collect()), key=key) == want


def test_representatives(odd, nothing, docs):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    groups = {(r.component_id, r.fingerprint if r.component_id is None else "") for r in simhash.groups(odd).collect()}
    assert len(got) == len(groups) and (False, 5) in got and (False, 6) not in got
    assert simhash.representatives(nothing).count() == 0 and simhash.groups(nothing).count() == 0
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == sorted({r.component_id for r in simhash.groups(docs).collect()})


def test_long_families_make_no_pairs():
    prints = np.array(family(9, 1, 20_000, 3), np.uint64)
    assert set(simhash.trie_self_join(prints, np.array([0, len(prints)])).tolist()) == {0}


def test_finer_parts_are_all_other_bits():
    for blocks in (5, 6, 7, 8):
        for mask in simhash.masks(blocks):
            parts = simhash.finer(mask)
            assert len(parts) == simhash.BUDGET + 1 and sum(parts) == (1 << 64) - 1 - mask and all(parts)
