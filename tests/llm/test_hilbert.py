import itertools
import zlib

import numpy as np
import pytest

from florilege.llm import hilbert


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_law(request, table):
    df = request.getfixturevalue(table)
    rows = hilbert.assigned(df).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(40)}
    assert all(v == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert [r.cell for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(r.cell for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, hilbert.assigned(df.repartition(5)).collect()), key=repr)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_cells_shards_and_slots_are_brute_force(request, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.place, r.text_crc32, r["size"], tuple(None if v is None else v.encode() if isinstance(v, str) else v for v in r["at"])) for r in hilbert.lean(df).collect()]
    n, bits = (1 << hilbert.BITS) - 1, []
    for d in range(3):
        values = sorted(r[4][d] for r in rows if r[4][d] is not None)
        cuts = {values[-(-k * len(values) // n) - 1] for k in range(1, n)} if values else set()
        bits.append([0 if r[4][d] is None else 1 + sum(r[4][d] > c for c in cuts) for r in rows])
    cells = hilbert.curve_index(np.array(bits).T).tolist()
    order = sorted((cell, r[1], r[0] is not None, r[0] or 0, *r[2:4]) for cell, r in zip(cells, rows))
    want = []
    for rank, (cell, _, known, doc, crc, size) in enumerate(order):
        shard = rank * hilbert.SHARDS // len(order)
        want.append((doc if known else None, size, crc, cell, shard, rank - -(-shard * len(order) // hilbert.SHARDS)))
    got = [(r.doc_id, r["size"], r.text_crc32, r.cell, r.shard, r.slot) for r in hilbert.assigned(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_common_prefixes_are_told_apart(spark):
    df = spark.createDataFrame([(k, "x", "en", f"https://site{k % 10}.org") for k in range(200)], "doc_id long, text string, lang string, source string")
    assert len({(r.source, r.cell) for r in hilbert.assigned(df).join(df, "doc_id").collect()}) == 10 == len({r.cell for r in hilbert.assigned(df).collect()})


def test_files_prune(spark, docs, tmp_path):
    hilbert.write_shards(docs, str(tmp_path / "s"), 40)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    per = back.groupBy("shard").agg({"lang": "approx_count_distinct"}).toDF("shard", "n").collect()
    assert sum(r.n for r in per) / len(per) < docs.select("lang").distinct().count()


def test_empty(nothing):
    assert hilbert.assigned(nothing).count() == 0
