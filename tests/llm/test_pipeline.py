import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from florilege.llm import mixing, quality, simhash
from florilege.llm.registry import ORACLE_SQL, QUERIES, vocabulary


def test_stages_and_result(spark, tiny, docs):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, stage(spark, step, tiny).cache()
        assert step.columns == docs.columns, name
        assert {r.doc_id for r in step.collect()} <= {r.doc_id for r in before.collect()}
        if name == "quality_rules":
            assert {r.doc_id for r in step.collect()} == {r.doc_id for r in quality.verdicts(before).filter("kept").collect()}
        if name == "near_dedup":
            assert {r.doc_id for r in step.collect()} == {r.component_id for r in simhash.groups(before).collect()}
        if name == "mix_sources":
            words = {r.doc_id: r.taken for r in mixing.mixed(before).collect()}
            got = {}
            for r in step.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
            assert got == {k: v for k, v in words.items() if v}
    want = []
    for r in step.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, tiny).collect()]
    assert sorted(got) == sorted(want)


def test_odd_tables_pass_through(spark, tiny, odd, nothing):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for df in (odd, nothing):
        step, ids = df, [r.doc_id for r in df.collect()]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, tiny).cache()
            rows = step.collect()
            assert step.columns == df.columns and {r.doc_id for r in rows} <= {*ids}, name
            assert all(r.n_chars == len(r.text) for r in rows), name
        got = sorted((r.doc_id or -1, r.n_tokens) for r in corpus_pipeline.encode(spark, step, tiny).collect())
        assert got == sorted((r.doc_id or -1, len(library.encode(r.text, add_special_tokens=False).ids)) for r in step.collect())
        assert bool(got) == bool(ids)


def test_queries(spark, tiny, same_as_sql):
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    for name, sql in ORACLE_SQL.items():
        same_as_sql(QUERIES[name](spark, tiny), sql)
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, tiny).count() > 0
