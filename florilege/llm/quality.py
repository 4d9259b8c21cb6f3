"""Quality rules, the last of them cross-document line frequency; DataFrame functions only.

Base rules count within a document. The method then counts, for each host (`source`), in how many distinct
documents each normalised line stands. Lines at the limit or above (MIN_DOCS documents, and SHARE of the host's) are
boilerplate and removed; a document that keeps less than LEFT of its words is rejected.

Documents are distinct texts, of lines and of hosts alike, so exact copies count once. Near copies of one text, which
are left to near-duplicate detection, count once too: of the texts that hold lines over the limit, those are edits of
such lines that share EDIT or more of the three-word windows of their other lines with lines over the limit of the
host (a line of fewer words is one window). For each line all edits that hold it count as one document; a page
with words of its own, and a text of nothing but lines over the limit, count for themselves.

A line is normalised by dropping ASCII blanks at its ends, lower-casing, and folding runs of blanks; lines
without a word are neither counted nor removed. Null and empty texts have no words and fail the base rules. Texts may
be of any length: a row needs a few times its own text. A null source is a host of its own. Null ids, ties and
repeated rows are counted and returned like any other row. An empty table gives an empty result. Other columns, of
whatever names, are kept by `clean` and ignored elsewhere.

Scale: counts are combined before each shuffle, so a hot host or line is a few rows a task. At most (mean lines of a
text) / SHARE lines of a host can be over its limit, so the arrays of them are bounded, whatever the host's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import BLANK_RUN, BLANKS, let, words
from florilege.runtime import written

MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_DOCS, SHARE, LEFT = 5, 0.02, 0.5
#: Share of the windows of its other lines from which a text is an edit of the lines over the limit.
EDIT = 0.5
SYMBOLS = "#*$%&|<>"


def _body(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_chars(text: Column) -> Column:
    bare = _body(text)
    for blank in BLANKS:
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    return F.length(bare).cast("long")


def n_symbols(text: Column) -> Column:
    bare = _body(text)
    for mark in SYMBOLS:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return (F.length(_body(text)) - F.length(bare)).cast("long")


def _lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(_body(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_repeat_words(found: Column) -> Column:
    """Words in windows of three that stand twice or more in an array of words.

    Windows are compared by their 64-bit hash. Sorting (hash, place) brings equal windows together; from the
    sorted places of repeated windows, each one covers the words that the one before it doesn't.
    """

    def covered(windows: Column) -> Column:
        def places(s: Column) -> Column:
            def same(k: Column, other: Column) -> Column:
                return F.coalesce(F.get(s, other)["h"] == F.get(s, k)["h"], F.lit(False))

            last = F.size(s) - 1
            found = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get(s, k)["i"]))
            return F.sort_array(F.filter(found, F.isnotnull))

        def width(p: Column) -> Column:
            steps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))
            return F.when(F.size(p) < 2, F.lit(0)).otherwise(3 + F.aggregate(steps, F.lit(0), lambda a, x: a + x))

        hashes = F.transform(windows, lambda w: w["h"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(windows), F.lit(0)).otherwise(let(let(F.sort_array(windows), places), width))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    return let(found, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), covered))).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.col("text")
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words")))
    out = docs.withColumn("_counted", counted)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        out.withColumns({"n_words": F.col("_counted.n_words"), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": F.col("_counted.n_repeat_words")})
        .withColumn("base_failed", failed)
        .drop("_counted")
    )


def normal(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.lower(F.when(bare.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(bare, BLANK_RUN, " ")).otherwise(bare))


def line_hash(line: Column) -> Column:
    """64 bits of a normalised line; null for a line without a word."""
    return F.when(F.btrim(line, F.lit(BLANKS)) != "", F.xxhash64(normal(line)))


def windows(line: Column) -> Column:
    """Hashes of a line's three-word windows; fewer words are one window."""

    def each(w: Column) -> Column:
        of_three = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.array(F.xxhash64(w))).otherwise(of_three)

    return let(words(normal(line)), each)


def _host() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def over_limit(docs: DataFrame) -> DataFrame:
    """host, hash and least (the limit) of the lines that so many distinct texts of the host hold."""
    key = F.xxhash64(_body(F.col("text"))).alias("key")
    hashes = F.array_distinct(F.filter(F.transform(F.split(_body(F.col("text")), "\n"), line_hash), F.isnotnull))
    held = docs.select(_host().alias("host"), key, F.explode(hashes).alias("hash")).groupBy("host", "hash", "key").agg(F.lit(1).alias("one"))
    per_line = held.groupBy("host", "hash").agg(F.count("one").alias("n_texts"))
    texts = docs.select(_host().alias("host"), key).groupBy("host", "key").agg(F.lit(1).alias("one"))
    hosts = texts.groupBy("host").agg(F.greatest(F.lit(float(MIN_DOCS)), SHARE * F.count("one")).alias("least"))
    return per_line.filter(F.col("n_texts") >= MIN_DOCS).join(hosts, "host").filter("n_texts >= least").select("host", "hash", "least")


def boilerplate(docs: DataFrame) -> DataFrame:
    """host, hash of the lines that stay at or above their host's limit where edits count as one document."""
    over = written(over_limit(docs), "over")
    by_host = over.groupBy("host").agg(F.collect_list("hash").alias("over"))

    def parts(lines: Column) -> Column:
        def of(hashes: Column) -> Column:
            held = F.array_intersect(hashes, F.col("over"))
            own = F.filter(lines, lambda line, i: ~F.array_contains(held, F.coalesce(F.get(hashes, i), F.lit(0))) & F.get(hashes, i).isNotNull())
            known = F.filter(F.transform(lines, lambda line, i: F.struct(F.get(hashes, i).alias("hash"), line.alias("line"))), lambda x: F.array_contains(held, F.coalesce(x["hash"], F.lit(0))))
            return F.when(F.size(held) > 0, F.struct(own.alias("own"), known.alias("known")))

        return let(F.transform(lines, line_hash), of)

    rows = docs.select(_host().alias("host"), F.xxhash64(_body(F.col("text"))).alias("key"), F.split(_body(F.col("text")), "\n").alias("lines"))
    rows = rows.join(written(by_host, "by_host"), "host").select("host", "key", let(F.col("lines"), parts).alias("p")).filter("p is not null")
    holders = written(rows.select("host", "key", "p.own", "p.known"), "holders")
    lines = holders.select("host", F.explode("known").alias("x")).groupBy("host", "x.hash").agg(F.first("x.line").alias("line"))
    seen = lines.select("host", F.explode(windows(F.col("line"))).alias("w")).groupBy("host").agg(F.collect_set("w").alias("seen"))

    def is_page(own: Column) -> Column:
        return (F.size(own) == 0) | (F.size(F.array_intersect(own, F.col("seen"))) < EDIT * F.size(own))

    judged = holders.join(written(seen, "seen"), "host")
    judged = judged.select("host", "key", F.array_distinct(F.transform("known", lambda x: x["hash"])).alias("held"), let(F.array_distinct(F.flatten(F.transform("own", windows))), is_page).alias("page"))
    once = judged.select("host", "key", "page", F.explode("held").alias("hash")).groupBy("host", "hash", "key").agg(F.first("page").alias("page"))
    n = once.groupBy("host", "hash").agg((F.count(F.when(F.col("page"), 1)) + F.max((~F.col("page")).cast("int"))).alias("n_docs"))
    return n.join(over, ["host", "hash"]).filter("n_docs >= least").select("host", "hash")


def _with_limits(docs: DataFrame) -> DataFrame:
    """docs with the base columns and `_above`, the host's boilerplate. That is a written table: its size is known when the
    join to it is planned, so that Spark broadcasts it only if it is small and shuffles (and splits a hot host) otherwise."""
    limits = written(boilerplate(docs).groupBy(F.col("host").alias("_host")).agg(F.collect_list("hash").alias("_above")), "limits")
    return base(docs).join(limits, _host() == F.col("_host"), "left").drop("_host")


def _stays() -> Column:
    """_at: the lines of the text that stay, and n: the words of those that don't; null where none goes."""

    def judged(lines: Column) -> Column:
        def of(hashes: Column) -> Column:
            def gone(held: Column) -> Column:
                goes = lambda i: F.coalesce(F.array_contains(held, F.get(hashes, i)), F.lit(False))
                lost = F.aggregate(F.filter(lines, lambda line, i: goes(i)), F.lit(0), lambda n, line: n + F.size(words(line)))
                return F.when(F.size(held) > 0, F.struct(F.filter(lines, lambda line, i: ~goes(i)).alias("lines"), lost.cast("long").alias("n")))

            return let(F.array_intersect(hashes, F.col("_above")), gone)

        return let(F.transform(lines, line_hash), of)

    return F.when(F.col("_above").isNotNull(), let(F.split(_body(F.col("text")), "\n"), judged))


def _kept(left: Column) -> Column:
    return ~F.col("base_failed") & (left >= LEFT * F.col("n_words"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and n_words_left of every row."""
    left = F.col("n_words") - F.coalesce(_stays()["n"], F.lit(0).cast("long"))
    rows = _with_limits(docs.select("doc_id", "text", "source")).withColumn("n_words_left", left)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _kept(F.col("n_words_left")).alias("kept"), "n_words_left")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their boilerplate removed and n_chars brought up to date; all columns as before."""
    apart = [c for c in docs.columns if c not in ("text", "source")]
    rest = F.struct(*[F.col(f"`{c}`") for c in apart]) if apart else F.lit(None)
    rows = _with_limits(docs.select(rest.alias("_rest"), "text", "source"))

    def kept(s: Column) -> Column:
        text = F.when(s.isNull(), F.col("text")).otherwise(F.array_join(s["lines"], "\n"))
        return F.when(_kept(F.col("n_words") - F.coalesce(s["n"], F.lit(0).cast("long"))), F.array(text)).otherwise(F.array().cast("array<string>"))

    # Rejected rows leave through an empty array: a filter would be pushed below the join, and count each text again for each of its terms.
    rows = rows.select("_rest", "source", F.explode(let(_stays(), kept)).alias("_text"))
    columns = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long"), "source": F.col("source")}
    return rows.select(*[columns.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])


VERDICTS_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
wins AS (SELECT r, unnest(range(1, greatest(len(w) - 1, 1)::BIGINT)) AS i, w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM wins),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (
  SELECT r, source, text, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM d),
lw AS (
  SELECT r, source, text, k, line, regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g') AS folded,
         line <> '' AND regexp_matches(line, '[^\x20\x09-\x0D]') AS has
  FROM ln),
h AS (
  SELECT r, source, text, k, line, has, CASE WHEN has THEN lower(trim(folded, ' ')) END AS norm,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM lw),
u AS (SELECT DISTINCT source, text, norm FROM h WHERE has),
host AS (SELECT source, greatest({MIN_DOCS}, {SHARE}::DOUBLE * count(DISTINCT text)) AS least FROM d GROUP BY source),
per AS (SELECT source, norm, count(*) AS n FROM u GROUP BY ALL),
over_ AS (
  SELECT per.source, per.norm, host.least FROM per JOIN host ON per.source IS NOT DISTINCT FROM host.source WHERE per.n >= host.least),
marked AS (
  SELECT u.source, u.text, u.norm, over_.norm IS NOT NULL AS above, max(over_.norm IS NOT NULL) OVER (PARTITION BY u.source, u.text) AS holds
  FROM u LEFT JOIN over_ ON u.source IS NOT DISTINCT FROM over_.source AND u.norm = over_.norm),
split_ AS (SELECT source, text, above, regexp_split_to_array(norm, ' ') AS w FROM marked WHERE holds),
three AS (
  SELECT DISTINCT source, text, above, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, (len(w) - 1)::BIGINT), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM split_),
seen AS (SELECT DISTINCT source, g FROM three WHERE above),
edit AS (
  SELECT three.source, three.text FROM three LEFT JOIN seen ON three.source IS NOT DISTINCT FROM seen.source AND three.g = seen.g
  WHERE NOT above GROUP BY three.source, three.text HAVING count(seen.g) >= {EDIT}::DOUBLE * count(*)),
n_docs AS (
  SELECT m.source, m.norm, count(*) - count(edit.text) + max(CASE WHEN edit.text IS NULL THEN 0 ELSE 1 END) AS n
  FROM marked m LEFT JOIN edit ON m.source IS NOT DISTINCT FROM edit.source AND m.text = edit.text WHERE m.above GROUP BY m.source, m.norm),
above AS (
  SELECT n_docs.source, n_docs.norm FROM n_docs JOIN over_ ON n_docs.source IS NOT DISTINCT FROM over_.source AND n_docs.norm = over_.norm
  WHERE n_docs.n >= over_.least),
left_ AS (
  SELECT h.r, sum(CASE WHEN above.norm IS NULL THEN words ELSE 0 END) AS n
  FROM h LEFT JOIN above ON h.source IS NOT DISTINCT FROM above.source AND h.norm = above.norm GROUP BY h.r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM h WHERE has GROUP BY r),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, left_.n::BIGINT AS n_words_left
  FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN left_ USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND n_words_left >= {LEFT}::DOUBLE * n_words AS kept,
       n_words_left
FROM b
"""
