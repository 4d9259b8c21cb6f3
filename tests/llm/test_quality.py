import re

from florilege.llm import quality


def test_equals_sql(spark, tiny, docs, odd, same_as_sql, as_table):
    same_as_sql(quality.verdicts(docs), quality.VERDICTS_SQL)
    same_as_sql(quality.verdicts(odd), quality.VERDICTS_SQL, tables=as_table(odd))


def repeats(words):
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    return len({k + d for places in windows.values() if len(places) > 1 for k in places for d in range(3)})


def test_base_is_brute_force(docs, odd):
    for df in (docs, odd):
        for r in quality.base(df.select("text")).collect():
            words = (r.text or "").encode().split()
            lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
            assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
            assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
            assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeats(words)
            assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))


def body(k, n=60):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_boilerplate_goes_and_copies_stay(spark):
    rows = [(k, f"Menu  HOME\n{body(k)}", "en", "h", 0) for k in range(10)]
    rows += [(100 + k, f"Menu home\n{body(999)}\n{body(998)}", "en", "h", 0) for k in range(8)]  # one text, eight times
    rows += [(200 + k, f"{body(k + 500)}\nshared {body(777, 80)}", "en", "h", 0) for k in range(9)]  # mostly a shared line
    rows += [(300, f"Menu home\n{body(5000)}", "en", "other", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    verdict = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert all(verdict[k].kept and verdict[k].n_words_left == 60 for k in range(10))
    assert all(verdict[100 + k].kept for k in range(8))
    assert not any(verdict[200 + k].kept or verdict[200 + k].base_failed for k in range(9))
    clean = {r.doc_id: r for r in quality.clean(df).collect()}
    assert clean[3].text == body(3) and clean[3].n_chars == len(body(3)) and clean[300].text.startswith("Menu") and 200 not in clean


def test_clean_keeps_columns(odd, nothing):
    out = quality.clean(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in quality.verdicts(odd).filter("kept").collect()}
    assert quality.clean(nothing).count() == 0 and quality.verdicts(nothing).count() == 0


def test_long_templates_go_and_near_copies_stay(spark):
    block = "\n".join(f"menu{j} with links{j} below" for j in range(30))
    article = [" ".join(f"a{j}x{i}" for i in range(14)) for j in range(12)]
    edited = lambda k: "\n".join(x.replace("x6", f"edit{k}") if j == k % 12 else x for j, x in enumerate(article))
    texts = [(k, f"{block}\n{body(k)}") for k in range(60)] + [(100 + k, edited(k)) for k in range(36)] + [(1000 + k, body(k + 1000)) for k in range(704)]
    rows = [(k, t, "en", s, 0) for k, t in texts for s in ("h", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.kept, r.n_words_left, r.n_words) for r in quality.verdicts(df).collect()]
    assert len(got) == 1600 and all(not kept and left == 60 for k, kept, left, _ in got if k < 60)  # 30 lines in 60 of 800 documents
    assert all(kept and left == n for k, kept, left, n in got if k >= 60)


def slow_boilerplate(rows):
    """Host -> normalised lines over the limit, counted document by document."""
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
    hosts = {}
    for r in rows:
        hosts.setdefault(r.source, {})[r.text or ""] = {norm(x) for x in (r.text or "").split("\n")} - {""}
    grams = lambda lines: {tuple(w[k : k + 3]) for w in (x.split(" ") for x in lines) for k in range(max(1, len(w) - 2))}
    out = {}
    for host, texts in hosts.items():
        least = max(quality.MIN_DOCS, quality.SHARE * len(texts))
        over = {x for lines in texts.values() for x in lines if sum(x in other for other in texts.values()) >= least}
        known, out[host] = grams(over), set()
        edit = {t: bool(g := grams(lines - over)) and len(g & known) >= quality.EDIT * len(g) for t, lines in texts.items()}
        for x in over:
            holders = [t for t, lines in texts.items() if x in lines]
            if sum(not edit[t] for t in holders) + any(edit[t] for t in holders) >= least:
                out[host].add(x)
    return out, norm


def check_slow(df):
    rows = df.select("doc_id", "text", "source").collect()
    above, norm = slow_boilerplate(rows)
    want = []
    for r in rows:
        left = sum(len(x.encode().split()) for x in (r.text or "").split("\n") if norm(x) not in above[r.source])
        want.append((r.doc_id, left))
    got = [(r.doc_id, r.n_words_left) for r in quality.verdicts(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return above


def test_documents_are_counted(spark, odd):
    check_slow(odd)
    menu = "\n".join(f"menu {j} of the site" for j in range(120))
    rows = [(k, f"{menu}\n{body(k, 300)}", "long") for k in range(100)] + [(k, f"top\nnext\nprivacy\n(c)\n{body(k)}", "short") for k in range(200, 208)]
    rows += [(k, "\n".join(f"part {j}" for j in range(12) if j != k % 12), None) for k in range(300, 324)] + [(k, body(k), "short") for k in range(400, 410)]
    above = check_slow(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert len(above["long"]) == 120 and len(above["short"]) == 4 and len(above[None]) == 12
