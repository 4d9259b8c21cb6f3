import pytest

from florilege.llm import mixing


def wanted(sizes):
    """Targets by repeated sharing."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    target, fixed = {}, set()
    while True:
        open_ = [n for n in names if n not in fixed]
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in fixed)
        target = {n: 2.0 * sizes[n] for n in fixed} | {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        new = {n for n in open_ if target[n] > 2 * sizes[n] + 1e-9}
        if not new:
            return target
        fixed |= new


@pytest.mark.parametrize("table, near", [("docs", 0.35), ("odd", None)])
def test_mix(request, table, near):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    want = wanted(sizes)
    source = {r.doc_id: r.source for r in rows}
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        own = source[r.doc_id]
        assert r.source_size == sizes[own] and r.target == pytest.approx(want[own]) and 0 <= r.taken <= 2 * r.size
        taken[own] += r.taken
    if near:
        largest = max(r.size for r in got)
        assert all(abs(taken[n] - want[n]) <= largest for n in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(df.repartition(7)).collect()), key=repr)


def test_many_small_documents_come_close(spark):
    rows = [(k, "w " * (k % 7 + 1), "abc"[k % 3]) for k in range(3000)] + [(9000 + k, "w " * 9000, "z") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    total = {}
    for r in mixing.mixed(df).join(df.select("doc_id", "source"), "doc_id").collect():
        t = total.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(abs(t - want) <= 3 for n, (t, want) in total.items() if n != "z")


def test_repeated_rows_are_taken_one_by_one(spark):
    rows = [(1, "w " * 10, "a") for _ in range(1000)] + [(None, "v " * 9, None) for _ in range(300)] + [(k, f"x{k} " * 100, "b") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    for size in (10, 9, 100):
        own = [r for r in got if r.size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= size / 2 + 1e-6 and {r.taken for r in own} <= {0, size, 2 * size}


def slow_times(rows):
    """How often each of (h, doc_id, nth, size) of one source is taken: the same descent, one document after another."""
    bits, target = [mixing.BITS] * mixing.DIGITS, rows[0]["target"]
    total = sum(r["size"] for r in rows)
    whole = int(target // total) if total else 0
    missing, inside, more = target - whole * total if total else 0.0, list(rows), set()
    key = lambda r: (r["h"], r["doc_id"], r["nth"])
    at = 64
    for width in bits:
        at -= width
        digit = lambda r: (r["h"] % (1 << 64)) >> at & mixing.BLOCKS - 1  # noqa: B023, E731
        for block in range(mixing.BLOCKS):
            own = [r for r in inside if digit(r) == block]
            n = sum(r["size"] for r in own)
            if n > missing or block == mixing.BLOCKS - 1 and not any(digit(r) > block for r in inside):
                if n > missing or block == mixing.BLOCKS - 1:
                    inside = own
                    break
            missing -= n
            more |= {key(r) for r in own}
    for r in sorted(inside, key=key):
        if r["size"] > missing:
            break
        missing -= r["size"]
        more.add(key(r))
    free = [r for r in rows if key(r) not in more and whole < 2 and 0 < r["size"] < 2 * missing]
    if free:
        more.add(key(min(free, key=lambda r: (abs(r["size"] - missing), *key(r)))))
    return {key(r): whole + (key(r) in more) for r in rows}


def test_taken_is_brute_force(docs):
    rows = mixing.lean(docs).cache()
    got = mixing.dealt(rows).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r.asDict())
    assert len(got) == docs.count()
    for own in by_source.values():
        want = slow_times(own)
        if own[0]["source_size"]:
            assert all(len(r["shards"]) == want[r["h"], r["doc_id"], r["nth"]] for r in own)


def test_tree_and_deal(spark, docs):
    rows = mixing.lean(docs).cache()
    _, state = mixing.chosen(rows)
    state = state.select("s", "whole", "taken_blocks").cache()
    tree = mixing.quotas(state.withColumnRenamed("s", "source"), 16)
    draws = {r.s: r.whole * mixing.BLOCKS + r.taken_blocks + 1 for r in state.collect()}
    per = tree.groupBy("shard").count().collect()
    assert sum(draws.values()) == sum(r["count"] for r in per) and max(r["count"] for r in per) - min(r["count"] for r in per) <= 4
    assert tree.select("source", "draw").distinct().count() == sum(draws.values())
    held = {}  # shards of each source: as many blocks as the tree gives, whatever their permutation
    for r in tree.collect():
        held.setdefault(r.source, []).append(r.shard)
    deal = {r.d: r.deal for r in mixing.deal(state, 16).collect()}
    for r in state.collect():
        assert [len(p) for p in deal[r.s]] == [mixing.BLOCKS] * r.whole + [r.taken_blocks + 1]
        assert sorted(x for p in deal[r.s] for x in p) == sorted(held[r.s])
        for p in deal[r.s][: r.whole]:  # the passes are permuted: no pass lists its shards in rising order
            assert p != sorted(p)
    block = lambda h: (h % (1 << 64)) >> 64 - mixing.BITS
    for r in mixing.dealt(rows, 16).collect():
        own = deal[r.source]
        assert r.shards[: r.whole] == [own[c][block(r.h)] for c in range(r.whole)]
        if len(r.shards) > r.whole:
            assert r.shards[r.whole] == own[r.whole][min(block(r.h), len(own[r.whole]) - 1)]


def test_mix_rows_are_taken_rows(odd, docs, nothing, tmp_path, spark):
    for df in (docs, odd):
        out = mixing.mix(df)
        assert out.columns[:-2] == df.columns
        taken, copies = {}, {}
        for r in mixing.mixed(df).collect():
            assert len(r.orders) == len(r.shards) and r.taken == len(r.shards) * r.size
            for draw in zip(r.shards, r.orders):
                taken[r.doc_id, draw] = taken.get((r.doc_id, draw), 0) + 1
        for r in out.select("doc_id", "text", "_mix_shard", "_mix_order").collect():
            draw = r.doc_id, (r._mix_shard, r._mix_order)
            copies[draw] = copies.get(draw, 0) + 1
        assert copies == taken
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    mixing.write_mix(docs, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == mixing.mix(docs).count()
    parts = mixing.in_shards(mixing.mix(docs)).select("_mix_shard", "_mix_order").rdd.glom().collect()
    flat = [tuple(r) for p in parts for r in p]
    assert [s for s, _ in flat] == sorted(s for s, _ in flat) and all([tuple(r) for r in p] == sorted(map(tuple, p)) for p in parts)
