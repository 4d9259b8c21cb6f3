"""Queries over the driver's tables, one or more for each family of operators, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege import schemas
from florilege.config import GEONAMES, OCCUPATIONS, parse_settings
from florilege.functions import text as T
from florilege.operators import annotate, clusters, joins, matching, predicates, ranking, tree, values, vectors
from florilege.plans import stages
from florilege.runtime import prepare, scratch, spread, table, written
from florilege.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A gazetteer of frequent words, so that matches exist in invented prose.
WORDS = [("article", "the,a,an"), ("copula", "is,are,was,were"), ("preposition", "of,in,by,for,with,of the"), ("pronoun", "it,this,that")]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def word_groups(spark: SparkSession) -> DataFrame:
    return files.flat_tree(spark.createDataFrame(WORDS, "name string, aliases string"))[1]


ALIASES_SQL = "(VALUES " + ", ".join(f"('{a}', '{n}', {len(a.split())})" for n, al in WORDS for a in al.split(",")) + ") AS g(gram, node_id, n)"
SENT_SQL = r"""s AS (SELECT doc_id, unnest(p) AS text, unnest(range(len(p)))::INT AS sent_i FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents))"""
WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
SURFACE_SQL = f"regexp_extract_all(text, '{T.TOKEN}')"
#: Sentences with something added by place, so that each rule holds for some and fails for others.
SEEDS = {1: "text || ' ..'", 2: "'www ' || text", 3: "text || ' http'", 4: "text || ' a-b-c'", 5: "'  '", 6: "'Write to joe@mail.org today. ' || text", 7: "text || ' It will be so.'", 8: "text || ' Smith lvl.'", 9: "text || ' a – b – c'", 10: "text || ' Results: none'"}
SEED_SQL = "v AS (SELECT doc_id, sent_i, CASE (doc_id + sent_i) % 23 " + " ".join(f"WHEN {k} THEN {x}" for k, x in SEEDS.items()) + " ELSE text END AS text FROM s)"
MATCH_SQL = f"""w AS (SELECT doc_id, sent_i, {WORDS_SQL} AS t FROM s),
gr AS (
  SELECT doc_id, sent_i, i AS match_start, n, array_to_string(t[i + 1:i + n], ' ') AS gram
  FROM (SELECT doc_id, sent_i, t, n, unnest(range(len(t) - n + 1)) AS i FROM w, (VALUES (1), (2)) AS k(n) WHERE len(t) >= n)),
m AS (SELECT doc_id, sent_i, node_id, gram AS match_text, match_start::INT AS match_start, (match_start + gr.n)::INT AS match_end FROM gr JOIN {ALIASES_SQL} USING (gram))"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_i", "text"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("(doc_id + sent_i) % 23")
    text = reduce(lambda a, k: a.when(kind == k, F.expr(SEEDS[k])), list(SEEDS)[1:], F.when(kind == 1, F.expr(SEEDS[1])))
    return sentences(spark, sf_dir).withColumn("text", text.otherwise(F.col("text")))


@query(f"WITH {SENT_SQL} SELECT doc_id, sent_i, text FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir)


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS token FROM documents) GROUP BY token")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SENT_SQL} SELECT word, count(*) AS n FROM (SELECT ({SURFACE_SQL})[1] AS word FROM s) GROUP BY word")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select(T.first_word(T.surface(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir).select(F.struct("doc_id", "sent_i").alias("sentence_id"), T.tokens(F.col("text")).alias("words"))
    return matching.gazetteer_matches(rows, word_groups(spark))


FLAT = ["sentence_id.doc_id", "sentence_id.sent_i", "node_id", "match_text", "match_start", "match_end"]


@query(f"WITH {SENT_SQL}, {MATCH_SQL} SELECT doc_id, sent_i, node_id, match_text, match_start, match_end FROM m")
def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select(*FLAT)


@query(f"""WITH {SENT_SQL}, {MATCH_SQL} SELECT doc_id, sent_i, node_id, match_text, match_start, match_end FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sent_i, node_id ORDER BY match_start, match_end) AS r FROM m) WHERE r = 1""")
def match_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_matches(matches(spark, sf_dir)).select(*FLAT)


PLAIN = ["is-short-enough", "has-at-least-one-token", "first-word-is-not-none", "starts-with-capital", "ends-with-period", "has-no-bad-first-word", "has-no-digits", "dot_dot", "www", "com", "http", "many_hyphens"]
STRIP_SQL = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
FIRST_SQL = f"({SURFACE_SQL})[1]"
LISTED = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
PLAIN_SQL = {
    "is-short-enough": f"length({STRIP_SQL}) <= {GEONAMES.max_length}",
    "has-at-least-one-token": f"len({SURFACE_SQL}) >= 1",
    "first-word-is-not-none": f"coalesce({FIRST_SQL} <> '', false)",
    "starts-with-capital": rf"coalesce(regexp_matches({FIRST_SQL}, '^\p{{Lu}}'), false)",
    "ends-with-period": f"suffix({STRIP_SQL}, '.')",
    "has-no-bad-first-word": f"coalesce(lower({FIRST_SQL}) NOT IN {LISTED(GEONAMES.bad_first_words)}, false)",
    "has-no-digits": r"NOT regexp_matches(text, '[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]')",
    "dot_dot": "NOT contains(text, '..')", "www": "NOT contains(text, 'www')", "com": "NOT contains(text, 'com')", "http": "NOT contains(text, 'http')",
    "many_hyphens": "length(text) - length(replace(text, '-', '')) < 2 AND length(text) - length(replace(text, '–', '')) < 2",
}
TOKEN_SHAPE = "array<struct<i:int,text:string,lower:string,pos:string,tag:string,dep:string,head:int,is_space:boolean,like_email:boolean>>"


def noted(rows: DataFrame) -> DataFrame:
    """Annotated rows; filters on them read columns, as the annotator's batches are not looked through."""
    return annotate.rule_annotator(rows.withColumn("tokens", T.surface(F.col("text"))))


@query(f"WITH {SENT_SQL}, {SEED_SQL} SELECT doc_id, sent_i, " + ", ".join(f'({sql}) AS "{name}"' for name, sql in PLAIN_SQL.items()) + " FROM v")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded(spark, sf_dir).withColumn("toks", annotate.leading(F.col("text")))
    return rows.select("doc_id", "sent_i", *[predicates.PREDICATES[p](GEONAMES).alias(p) for p in PLAIN])


@query(f"""WITH {SENT_SQL}, {MATCH_SQL}, ok AS (SELECT doc_id, sent_i FROM s WHERE {' AND '.join(f'({x})' for x in PLAIN_SQL.values())})
SELECT node_id, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_docs FROM (SELECT DISTINCT doc_id, sent_i, node_id FROM m) JOIN ok USING (doc_id, sent_i) GROUP BY node_id""")
def group_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir).withColumn("toks", annotate.leading(F.col("text")))
    for name in PLAIN:
        rows = rows.filter(predicates.PREDICATES[name](GEONAMES))
    words = rows.select(F.struct("doc_id", "sent_i").alias("sentence_id"), T.tokens(F.col("text")).alias("words"))
    found = matching.first_matches(matching.gazetteer_matches(words, word_groups(spark)))
    return found.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.countDistinct("sentence_id.doc_id").alias("n_docs"))


def _pos_sql() -> str:
    out = r"CASE WHEN NOT regexp_matches(l, '[\p{L}\p{N}]') THEN 'PUNCT' WHEN regexp_matches(l, '^[0-9]+$') THEN 'NUM'"
    for pos, listed in annotate.CLASSES.items():
        out += f" WHEN l IN {LISTED(listed.split())} THEN '{pos}'"
    return out + r" WHEN length(l) > 4 AND regexp_matches(l, '(ing|ed)$') THEN 'VERB' WHEN i > 0 AND regexp_matches(t, '^\p{Lu}') THEN 'PROPN' ELSE 'NOUN' END"


NOTED_SQL = rf"""{SEED_SQL}, tk AS (SELECT doc_id, sent_i, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT doc_id, sent_i, {SURFACE_SQL} AS x FROM v)),
lo AS (SELECT *, lower(t) AS l FROM tk), ps AS (SELECT *, {_pos_sql()} AS pos FROM lo),
tg AS (SELECT *, CASE WHEN l IN {LISTED(annotate.PAST)} THEN 'VBD' WHEN pos = 'VERB' AND suffix(l, 'ing') THEN 'VBG' WHEN pos = 'VERB' AND suffix(l, 'ed') THEN 'VBD' WHEN pos = 'AUX' THEN 'VBZ' ELSE pos END AS tag FROM ps),
rt AS (SELECT doc_id, sent_i, coalesce(min(i) FILTER (pos IN ('AUX', 'VERB')), 0) AS root, count(*) AS n FROM tg GROUP BY ALL),
an AS (SELECT tg.*, root, n FROM tg JOIN rt USING (doc_id, sent_i))"""
TOKEN_RULES = {
    "first-word-is-not-verb": "bool_or(i = 0 AND pos <> 'VERB')",
    "first-word-is-not-conjunction": "bool_or(i = 0 AND pos NOT IN ('CCONJ', 'SCONJ'))",
    "noun-exists-before-root": "bool_or(pos IN ('NOUN', 'PROPN') AND i < root)",
    "all-propn-have-acceptable-ne-labels": r"NOT bool_or(pos = 'PROPN')",
    "has-no-pronouns": f"NOT bool_or(pos = 'PRON' AND l IN {LISTED(OCCUPATIONS.pronouns)})",
    "root-has-nsubj-or-nsubjpass": "bool_or(pos IN ('NOUN', 'PROPN', 'PRON') AND i < root)",
    "has-no-email": r"NOT bool_or(regexp_matches(t, '^[\w.+-]+@[\w-]+\.\w'))",
    "remove-non-verb-roots": "bool_or(i = root AND pos IN ('VERB', 'AUX'))",
    "remove-first-word-roots": "max(root) <> 0",
    "remove-present-participle-roots": "bool_or(i = root AND tag <> 'VBG')",
    "remove-past-tense-roots": "bool_or(i = root AND tag <> 'VBD')",
}


@query(f"WITH {SENT_SQL}, {NOTED_SQL} SELECT doc_id, sent_i, " + ", ".join(f'{sql} AS "{name}"' for name, sql in TOKEN_RULES.items()) + " FROM an GROUP BY doc_id, sent_i")
def token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noted(seeded(spark, sf_dir)).filter(F.size("toks") > 0)
    return rows.select("doc_id", "sent_i", *[predicates.PREDICATES[p](OCCUPATIONS).alias(p) for p in TOKEN_RULES])


@query(f"""WITH {SENT_SQL}, {NOTED_SQL} SELECT doc_id, sent_i, (count(*) FILTER (pos = 'NOUN') + 1)::DOUBLE / (count(*) + 1) AS noun_density FROM an GROUP BY doc_id, sent_i""")
def noun_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noted(seeded(spark, sf_dir)).filter(F.size("toks") > 0)
    return rows.select("doc_id", "sent_i", T.noun_density(F.col("toks")).alias("noun_density"))


@query(f"""WITH {SENT_SQL}, {NOTED_SQL} SELECT doc_id, sent_i, t AS match_text, i::INT AS match_start, 'capital' AS node_id FROM an WHERE pos = 'PROPN'""")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noted(seeded(spark, sf_dir)).filter(F.size("ents") > 0).select(F.struct("doc_id", "sent_i").alias("sentence_id"), "ents")
    rows = written(rows, "entities")  # read twice
    names = rows.select(F.explode("ents").alias("e")).select(F.lower("e.text").alias("alias")).distinct().withColumn("node_id", F.lit("capital"))
    return matching.entity_matches(rows, names).select("sentence_id.doc_id", "sentence_id.sent_i", "match_text", "match_start", "node_id")


RULE_SQL = {
    "start": f"NOT coalesce(bool_or(i = 0 AND l IN {LISTED(values.OCCUPATION_STARTS)}), false)",
    "entities": "NOT bool_or(pos = 'PROPN')",
    "pronouns": f"NOT bool_or(pos = 'PRON' AND l IN {LISTED(values.OCCUPATION_PRONOUNS)})",
    "will": "NOT bool_or(pos = 'AUX' AND l = 'will')",
    "names": f"NOT bool_or(t IN {LISTED(values.COMMON_NAMES)})",
    "pointers": "NOT bool_or(l IN ('this', 'these'))",
    "auxiliaries": f"NOT bool_or(pos = 'AUX' AND l IN {LISTED(values.OCCUPATION_AUXILIARIES)})",
    "words": f"NOT bool_or(l IN {LISTED(values.OCCUPATION_WORDS)})",
    "capitals": "NOT bool_or(length(t) >= 4 AND t = upper(t) AND t <> l)",
    "root": "count(*) - max(root) > 2",
    "pattern": "NOT regexp_matches(any_value(text), '(?i)" + values.OCCUPATION_PATTERN.replace("'", "''") + "')",
}


@query(f"WITH {SENT_SQL}, {NOTED_SQL} SELECT doc_id, sent_i, " + ", ".join(f'{sql} AS "{name}"' for name, sql in RULE_SQL.items()) + " FROM an JOIN v USING (doc_id, sent_i) GROUP BY doc_id, sent_i")
def occupation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noted(seeded(spark, sf_dir)).filter(F.size("toks") > 0).withColumn("rep", F.col("text"))
    rules = ranking.occupation_filters()
    return rows.select("doc_id", "sent_i", *[rules[r].alias(r) for r in RULE_SQL])


@query(f"WITH {SENT_SQL} SELECT doc_id, sent_i, NOT regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])the (ha|blen)') AS no_the FROM s")
def alias_after_the(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir).select("doc_id", "sent_i", F.lit("g").alias("node_id"), F.col("text").alias("rep"))
    names = spark.createDataFrame([("ha", "g"), ("blen", "g")], schemas.ALIASES)
    return ranking.without_the(rows, names).select("doc_id", "sent_i", "no_the")


# Sources and sinks: what is written is read again.


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark, name)}/table"


@query("SELECT text, source AS timestamp, CASE WHEN doc_id % 2 = 0 THEN lang END AS url FROM documents")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    docs.select("text", F.col("source").alias("timestamp"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("url")).write.json(path)
    return files.corpus(spark, path)


@query("SELECT doc_id, text, lang AS url FROM documents")
def annotated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "annotated")
    files.write_annotated(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("url")), path)
    return files.annotated(spark, path)


@query("SELECT DISTINCT trim(p_type) AS file_path FROM part WHERE trim(p_type) <> ''")
def file_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "list")
    table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("value")).write.text(path)
    return files.file_list(spark, path)


@query("SELECT n_name AS node_id FROM nation")
def node_id_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "ids")
    table(spark, sf_dir, "nation").select("n_name").union(spark.createDataFrame([(" ",)], "x string")).write.text(path)
    return files.node_ids(spark, path)


@query("SELECT DISTINCT lower(trim(a)) AS alias, p_name AS node_id FROM (SELECT p_name, unnest([p_name, p_brand, p_type]) AS a FROM part) WHERE trim(a) <> ''")
def gazetteer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "gazetteer")
    part = table(spark, sf_dir, "part")
    part.select(F.col("p_name").alias("name"), F.concat_ws(",", "p_name", F.concat(F.lit(" "), "p_brand"), F.lit(" "), "p_type").alias("aliases")).write.csv(path, sep="\t", header=True, quote="")
    return files.gazetteer(spark, path)[1]


@query("SELECT s_suppkey::VARCHAR AS geonameid, s_name AS name, [s_name, 'x'] AS alternatenames, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END::INT AS population FROM supplier")
def place_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "places")
    supplier = table(spark, sf_dir, "supplier")
    cells = {"geonameid": F.col("s_suppkey").cast("string"), "name": F.col("s_name"), "alternatenames": F.concat("s_name", F.lit(",x,")), "population": F.when(F.col("s_suppkey") % 3 == 0, "unknown").otherwise(F.col("s_suppkey").cast("string"))}
    names = [c.split(" ")[0] for c in schemas.PLACES.split(", ")]
    supplier.select(*[cells.get(c, F.lit("")).alias(c) for c in names]).write.csv(path, sep="\t", quote="", emptyValue="")
    return files.places(spark, path).select("geonameid", "name", "alternatenames", "population")


@query("SELECT o_orderkey::VARCHAR AS geoname_id, o_orderpriority AS alternate_name, o_orderkey % 2 = 1 AS is_preferred, false AS is_short FROM orders")
def alternate_name_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "alternates")
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    o.select(F.lit("1"), key.cast("string"), F.lit("en"), "o_orderpriority", (key % 2).cast("string").alias("p"), F.lit("no").alias("q"), F.lit("").alias("r"), F.lit("0").alias("s"), F.lit("").alias("t"), F.lit("").alias("u")).toDF(*"abcdefghij").write.csv(path, sep="\t", quote="", emptyValue="")
    return files.alternate_names(spark, path).select("geoname_id", "alternate_name", "is_preferred", "is_short")


@query("SELECT n_regionkey::VARCHAR AS key, n_name AS value FROM nation")
def demonym_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "demonyms")
    nation = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("k")).agg(F.collect_list("n_name").alias("v"))
    nation.coalesce(1).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).write.text(path)
    return files.demonyms(spark, path)


@query("SELECT n_regionkey::VARCHAR AS head, min_by(n_name, n_nationkey) AS tail FROM nation GROUP BY 1")
def form_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "forms")
    table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("head"), F.col("n_name").alias("tail"), "n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey").drop("n_nationkey").write.csv(path, header=True)
    return files.form_of(spark, path)


@query("SELECT conv_id, list(text ORDER BY turn, text) AS texts FROM conversations GROUP BY conv_id")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "results")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    files.write_results(rows, path)
    return spark.read.schema("conv_id long, texts array<string>").json(path)


def places_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World, regions, nations and suppliers as nodes."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    root = spark.createDataFrame([("W", None, "World")], "node_id string, parent_id string, name string")
    rows = root.union(region.select(F.concat(F.lit("R"), "r_regionkey"), F.lit("W"), "r_name")).union(nation.select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), "n_name"))
    return rows.union(supplier.select(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey"), "s_name"))


TREE_SQL = """t AS (SELECT 'W' AS node_id, NULL AS parent_id, 'World' AS name UNION ALL SELECT 'R' || r_regionkey, 'W', r_name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name FROM supplier)"""


@query(f"WITH RECURSIVE {TREE_SQL}, l AS (SELECT node_id, 0 AS level FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, level + 1 FROM t JOIN l ON t.parent_id = l.node_id) SELECT node_id, level FROM l")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.levels(places_tree(spark, sf_dir), "W").select("node_id", "level")


@query(f"WITH RECURSIVE {TREE_SQL}, l AS (SELECT node_id, [name] AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, list_append(path, name) FROM t JOIN l ON t.parent_id = l.node_id) SELECT node_id, path FROM l")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths(places_tree(spark, sf_dir))


@query("SELECT 'S' || s_suppkey AS node_id, CASE WHEN n_nationkey % 2 = 0 THEN 'N' || n_nationkey ELSE 'R' || n_regionkey END AS parent_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = places_tree(spark, sf_dir)
    there = ~F.col("node_id").rlike("^N[0-9]*[13579]$")
    up = rows.filter("parent_id is not null").select(F.col("node_id").alias("child_id"), "parent_id")
    return tree.nearest(rows.filter(there).select("node_id"), up).filter("node_id like 'S%'")


@query("SELECT 'W' AS parent_id, 'R' || r_regionkey AS child_id, 'DERV' AS type FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'DERV' FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'DERV' FROM supplier")
def tree_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "hierarchy")
    files.write_hierarchy(places_tree(spark, sf_dir), path)
    return files.hierarchy(spark, path).drop("line")


@query("SELECT s_suppkey::VARCHAR AS child_id, 'C' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '.00' ELSE '.x.2' END AS parent_id FROM supplier WHERE s_suppkey > 5 UNION ALL SELECT s_suppkey::VARCHAR, 'H' FROM supplier WHERE s_suppkey <= 5")
def parent_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    rows = s.select(F.col("s_suppkey").cast("string").alias("geonameid"), F.concat(F.lit("C"), "s_nationkey").alias("country_code"), F.when(even, "00").otherwise("x").alias("admin1"), F.when(even, "00").otherwise("2").alias("admin2"))
    known = s.filter("s_suppkey <= 5").select(F.col("s_suppkey").cast("string").alias("child_id"), F.explode(F.array(F.lit("H"), F.lit("later"))).alias("parent_id")).withColumn("line", F.when(F.col("parent_id") == "H", 1).otherwise(2))
    codes = rows.select(F.when(F.col("admin2") == "00", F.concat_ws(".", "country_code", "admin1")).otherwise(F.concat_ws(".", "country_code", "admin1", "admin2")).alias("code")).distinct().withColumn("geoname_id", F.col("code"))
    return tree.parents(rows, known, codes)


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND NOT (p_size % 3 = 1 AND p_retailprice < 1000) AND NOT (p_size % 3 = 2 AND p_partkey % 2 = 0)")
def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("XXX"), F.lit("PPL"), F.lit("ADM3")), F.col("p_size") % 3 + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", code.alias("feature_code"), F.col("p_retailprice").alias("population"), F.when(F.col("p_partkey") % 2 == 0, "00").otherwise("7").alias("admin2"))
    return tree.features(rows).select("p_partkey")


@query("""SELECT n_nationkey, list_sort(list_distinct(list_filter(list_transform([n_name, d, CASE WHEN regexp_matches(d, '(s|ese|sh|ch|x|y|z|man)$') THEN '' ELSE d || 's' END, CASE WHEN suffix(d, 'man') THEN d[:-4] || 'men' ELSE '' END], lambda a: lower(trim(a))), lambda a: a <> ''))) AS aliases
FROM (SELECT n_nationkey, n_name, n_name || (['an', 'ese', 'man', 'ish', 'i'])[n_nationkey % 5 + 1] AS d FROM nation)""")
def alias_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e in ("an", "ese", "man", "ish", "i")]), F.col("n_nationkey") % 5 + 1)
    rows = table(spark, sf_dir, "nation").withColumn("d", F.concat("n_name", ending))
    return rows.select("n_nationkey", F.sort_array(tree.alias_sets(F.array("n_name"), F.array("d"))).alias("aliases"))


@query("SELECT n_nationkey::VARCHAR AS node_id, coalesce(min_by(c_name, c_custkey) FILTER (c_custkey % 7 = 0), any_value(n_name)) AS short_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("node_id"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_nationkey").cast("string").alias("geoname_id"), F.col("c_name").alias("alternate_name"), F.lit("en").alias("iso_language"), (F.col("c_custkey") % 7 == 0).alias("is_preferred"), F.col("c_custkey").alias("line"))
    return tree.short_names(nodes, names).select("node_id", "short_name")


@query("SELECT n_nationkey::VARCHAR AS node_id, list_sort(list(DISTINCT c_mktsegment)) AS names FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 1 GROUP BY 1")
def alternate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("node_id"))
    c = table(spark, sf_dir, "customer")
    names = c.select(F.col("c_nationkey").cast("string").alias("geoname_id"), F.col("c_mktsegment").alias("alternate_name"), F.when(F.col("c_custkey") % 2 == 1, "en").otherwise("link").alias("iso_language"))
    return tree.alternates_of(nodes, names).select("node_id", F.sort_array("names").alias("names"))


BEST_SQL = "(SELECT lower(trim(p_name)) AS alias, p_partkey AS node_id, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY -p_retailprice, p_size, p_partkey) AS r FROM part)"


def part_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("population"), F.col("p_size").alias("level"))


@query(f"SELECT alias, node_id FROM {BEST_SQL} WHERE r = 1")
def alias_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_nodes(part_aliases(spark, sf_dir))


@query(f"SELECT p_partkey, b.node_id FROM part LEFT JOIN {BEST_SQL} b ON b.r = 1 AND b.alias = lower(p_brand) OR b.r = 1 AND p_partkey % 2 = 0 AND b.alias = lower(trim(p_name))")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_brand")).alias("m"))
    return matching.node_of(mentions, part_aliases(spark, sf_dir), "m").select("p_partkey", "node_id")


@query("SELECT count(DISTINCT p_name) AS n_aliases, count(*) AS n_entries FROM part")
def alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.alias_counts(part_aliases(spark, sf_dir))


@query(f"SELECT node_id, list_sort(list(DISTINCT demonym)) AS demonyms FROM (SELECT p_brand AS demonym, lower(p_name) AS alias FROM part) JOIN {BEST_SQL} b USING (alias) WHERE r = 1 GROUP BY node_id")
def demonym_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return tree.attach_demonyms(part_aliases(spark, sf_dir), raw)


# Filters, joins and collections.


@query("SELECT page_id, NOT (contains(coalesce(url, ''), '.tk/') OR contains(coalesce(url, ''), '.net/')) AS reliable FROM pages")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = predicates.PREDICATES["not-from-unreliable-source"](replace(GEONAMES, domain_tails=("tk", "net")))
    return table(spark, sf_dir, "pages").select("page_id", rule.alias("reliable"))


NETLOC_SQL = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


@query(f"SELECT page_id, {NETLOC_SQL} AS netloc FROM pages")
def netloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.netloc(F.col("url")).alias("netloc"))


@query(f"""SELECT k, n, n_texts, n_domains, n_texts <> 1 AND n_texts / n::DOUBLE >= {1 / 3!r} AND n_domains / n::DOUBLE >= {1 / 3!r} AS diverse FROM (
  SELECT page_id % 40 AS k, count(*) AS n, count(DISTINCT lower(CASE WHEN page_id % 4 = 0 THEN 'one text' WHEN page_id % 4 = 1 THEN 'text ' || page_id % 3 ELSE html END)) AS n_texts, count(DISTINCT CASE WHEN page_id % 3 = 0 THEN 'none' ELSE '=' || {NETLOC_SQL} END) AS n_domains FROM pages GROUP BY 1)""")
def cluster_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("k"), F.expr("CASE WHEN page_id % 4 = 0 THEN 'one text' WHEN page_id % 4 = 1 THEN 'text ' || page_id % 3 ELSE html END").alias("text"), F.when(F.col("page_id") % 3 == 0, None).otherwise(F.col("url")).alias("url"))
    return ranking.diversity(rows, ["k"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as maps of scores; every seventh lacks a key."""
    rows = table(spark, sf_dir, "labels")
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    full = F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array(q, t))
    return rows.select(F.col("doc_id").alias("sentence_id"), F.when(F.col("doc_id") % 7 == 0, F.map_from_arrays(F.array(F.lit("quality")), F.array(q))).otherwise(full).alias("scores"))


@query("SELECT doc_id AS sentence_id FROM labels WHERE quality >= 0.5 AND toxic <= 0.3 AND doc_id % 7 <> 0")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replace(GEONAMES, counter_labels=("toxic",))
    return scored(spark, sf_dir).filter(joins.passes(F.col("scores"), "quality", s)).select("sentence_id")


@query("SELECT doc_id AS sentence_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels")
def score_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", T.score_map(F.array(F.lit("quality"), F.lit("toxic")), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))).alias("m"))
    return rows.select(F.col("doc_id").alias("sentence_id"), F.col("m")["quality"].alias("quality"), F.col("m")["toxic"].alias("toxic"))


@query("SELECT d.doc_id AS sentence_id, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def generic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sentence_id"), "toxic", (F.col("quality") == 1).alias("is_generic"))
    return joins.labelled(joins.generic_only(docs, labels), labels.select("sentence_id", "toxic"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def existing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_yet(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3')")
def file_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.in_files(table(spark, sf_dir, "documents").withColumnRenamed("source", "file_path"), ["src1", "src3"]).select("doc_id")


@query("SELECT o_orderkey AS sentence_id, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sentence_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_linenumber").alias("match_start"), F.col("l_partkey").alias("match_end"), F.lit("").alias("node_id"), F.lit("").alias("match_text"))
    rows = matching.with_matches(orders, items)
    return rows.select("sentence_id", F.coalesce(F.transform("matches", lambda m: m["match_start"]), F.array(F.lit(None).cast("int"))).alias("lines"))


@query("SELECT o_orderkey AS sentence_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey < 50)")
def any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sentence_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_partkey").alias("node_id"))
    return matching.any_match(orders, items, table(spark, sf_dir, "part").filter("p_partkey < 50").select(F.col("p_partkey").alias("node_id")))


@query("SELECT s_suppkey, n_name AS subject FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("short_name"))
    return joins.named(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("node_id")), nodes).select("s_suppkey", "subject")


@query("SELECT c_nationkey AS cluster_id, o_orderkey AS sentence_id, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def id_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sentence_id"), "o_totalprice", "o_custkey")
    owned = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("cluster_id")).agg(F.concat(F.collect_list("sentence_id"), F.array(F.lit(-1).cast("bigint"))).alias("sentence_ids"))
    return joins.members(owned, orders.drop("o_custkey"))


@query("""SELECT c_custkey, 'old' AS state FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 5 = 0""")
def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    old = files.delete_by_key(c, c.filter("c_custkey % 3 = 0"), "c_custkey").withColumn("state", F.lit("old"))
    return files.upsert(old, c.filter("c_custkey % 5 = 0").withColumn("state", F.lit("new")), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM customer")
def collection_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    out = files.insert_absent(c.filter("c_custkey % 2 = 0").withColumn("state", F.lit("old")), c.withColumn("state", F.lit("new")), "c_custkey")
    path = _folder(spark, "collection")
    files.write_collection(out, path, "c_custkey")
    return spark.read.parquet(path)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def collection_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return files.distinct_keys(files.read_by_key(table(spark, sf_dir, "orders"), keys, "o_custkey"), "o_custkey")


# Windows, groups and scores.


@query("SELECT user_id AS node_id, event_id AS sentence_id, value, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS position FROM events) WHERE position <= 5")
def top_k_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("sentence_id"), "value")
    return clusters.top(rows, "value", 5)


@query("""SELECT node_id, source, cluster_rank FROM (SELECT lang AS node_id, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min(doc_id))::INT AS cluster_rank FROM documents GROUP BY 1, 2)
WHERE cluster_rank <= 15 AND n >= 5""")
def cluster_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("node_id"), "source").agg(F.collect_list("doc_id").alias("sentence_ids"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return clusters.cut(clusters.ranks(rows, "node_id", "n", "first"), 15, 5).select("node_id", "source", "cluster_rank")


@query("SELECT conv_id, min_by(text, (length(text), text)) AS rep FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def shortest_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.representatives(table(spark, sf_dir, "conversations"), ["conv_id"])


@query("""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), text) AS k FROM (SELECT DISTINCT conv_id, text FROM conversations)),
l AS (SELECT conv_id, k, '(' || k || ') ' || text AS line, 58 + sum(length('(' || k || ') ' || text) + 1) OVER (PARTITION BY conv_id ORDER BY k) AS n FROM t),
c AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY conv_id ORDER BY k), 0) AS before FROM l)
SELECT conv_id, 'Given the following sentences sorted by length:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY k) || chr(10) || chr(10) || 'Summarize them using one sentence:' AS prompt FROM c WHERE before <= 310 GROUP BY conv_id""".replace("58 +", "48 +"))
def prompt_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.prompts(table(spark, sf_dir, "conversations"), ["conv_id"], 310)


STOP_SQL = LISTED(T.STOP_WORDS)
CONCEPT_SQL = f"""w AS (SELECT conv_id, turn, {SURFACE_SQL} AS t FROM conversations),
x AS (SELECT conv_id, turn, n, t[i + 1:i + n] AS g FROM (SELECT conv_id, turn, t, n, unnest(range(len(t) - n + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS k(n) WHERE len(t) >= n)),
ok AS (SELECT DISTINCT conv_id, turn, n, lower(array_to_string(g, ' ')) AS gram FROM x
  WHERE len(list_filter(g, lambda t: NOT regexp_matches(t, '^\\p{{L}}+$') OR lower(t) IN {STOP_SQL})) = 0),
sz AS (SELECT conv_id, count(*) AS n_sentences FROM conversations GROUP BY 1),
cn AS (SELECT conv_id, n, gram, count(*) AS cnt FROM ok GROUP BY ALL),
kp AS (SELECT conv_id, n, gram, cnt FROM cn JOIN sz USING (conv_id) WHERE cnt / n_sentences::DOUBLE >= 0.6)"""


@query(f"""WITH {CONCEPT_SQL} SELECT conv_id, list(gram ORDER BY cnt DESC, n, gram) AS concepts FROM kp a
WHERE NOT EXISTS (SELECT 1 FROM kp b WHERE a.conv_id = b.conv_id AND b.n > a.n AND contains(' ' || b.gram || ' ', ' ' || a.gram || ' ')) GROUP BY conv_id""")
def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", T.surface(F.col("text")).alias("tokens"))
    return ranking.concepts(rows, ["conv_id"], GEONAMES, ascii_only=False)


@query(f"""WITH {CONCEPT_SQL}, e AS (SELECT conv_id, gram, 'g' || conv_id % 5 AS subject FROM kp), sp AS (SELECT gram FROM e GROUP BY gram HAVING count(DISTINCT subject) / 5.0 < 0.6)
SELECT conv_id AS id, count(*) AS n FROM e JOIN sp USING (gram) WHERE gram NOT IN {LISTED(values.BAD_CONCEPTS['food'])} GROUP BY 1""")
def concept_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", T.surface(F.col("text")).alias("tokens"))
    each = F.flatten(F.array(*[T.concept_grams(F.col("tokens"), n) for n in (1, 2, 3)]))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    grams = rows.select("conv_id", F.explode(each).alias("g")).groupBy("conv_id", "g").agg(F.count(F.lit(1)).alias("c")).join(sizes, "conv_id").filter("c / n_sentences >= 0.6")
    listed = grams.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list("g").alias("concepts")).withColumn("subject", F.concat(F.lit("g"), F.col("id") % 5))
    return ranking.good_concepts(listed, "food", 5).select("id", F.size("concepts").cast("long").alias("n")).filter("n > 0")


@query("""SELECT source, avg(quality::DOUBLE) AS prob, avg(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE toxic END::DOUBLE) AS mean_food, avg(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE toxic END::DOUBLE) <= 0.1 AS own
FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select(F.col("sentence_id").alias("doc_id"), F.map_from_arrays(F.transform(F.map_keys("scores"), lambda k: F.when(k == "toxic", "food").otherwise(k)), F.map_values("scores")).alias("scores"))
    means = ranking.mean_scores(rows.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"), ["source"], "quality")
    return means.select("source", "prob", "mean_food", ranking.own_facet("ritual", 0.1).alias("own"))


@query(r"""WITH f AS (SELECT conv_id, turn, (string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))[1] || CASE turn % 4 WHEN 1 THEN ' The menu.' WHEN 2 THEN ' See sentence 3.' ELSE '' END AS rep FROM conversations)
SELECT conv_id, turn, suffix(rep, '.') AND length(rep) BETWEEN 20 AND 100 AS by_length,
  len(list_filter(regexp_split_to_array(rep, '\s+'), lambda w: w <> '')) >= 3 AND lower(list_filter(regexp_split_to_array(rep, '\s+'), lambda w: w <> '')[1]) NOT IN """ + LISTED(values.BAD_REP_STARTS) + r""" AS by_words,
  NOT regexp_matches(rep, '(?i)' || '""" + "') AND NOT regexp_matches(rep, '(?i)' || '".join(p.replace("'", "''") for p in values.BY_FACET["food"]) + r"""') AS by_pattern FROM f""")
def rep_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(T.first_sentence(F.col("text")), F.expr("CASE turn % 4 WHEN 1 THEN ' The menu.' WHEN 2 THEN ' See sentence 3.' ELSE '' END")).alias("rep"))
    rep = F.col("rep")
    return rows.select("conv_id", "turn", ranking.rep_length(rep, GEONAMES).alias("by_length"), F.coalesce(ranking.rep_words(rep, GEONAMES), F.lit(False)).alias("by_words"), ranking.rep_patterns(rep, "food").alias("by_pattern"))


DOT_SQL = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


def similar(threshold: float) -> str:
    return f"""WITH p AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM p)
SELECT a.vec_id, count(*) AS df FROM u a JOIN u b ON list_inner_product(a.v, b.v) >= {threshold} GROUP BY 1"""


@query(similar(GEONAMES.idf_threshold))
def cosine_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_counts(table(spark, sf_dir, "embeddings").withColumn("embedding", F.slice("embedding", 1, 4)), "vec_id", "embedding", GEONAMES.idf_threshold)


@query(f"WITH d AS ({similar(GEONAMES.idf_threshold)}), n AS (SELECT count(*) AS n, min(df) AS least FROM d) SELECT vec_id, round(ln(n / df::DOUBLE) / ln(n / least::DOUBLE), 9) AS idf FROM d, n")
def inverse_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.inverse_frequency(cosine_df(spark, sf_dir)).select("vec_id", F.round("idf", 9).alias("idf"))


@query("SELECT vec_id, round(list_inner_product(v, v), 9) AS dot, round(list_inner_product(v, v) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(v, v))), 9) AS cosine FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(T.dot(v, v), 9).alias("dot"), F.round(T.cosine(v, T.unit(v)), 9).alias("cosine"))


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS subject, p_size AS size, p_partkey % 3 > 0 AS has, p_partkey % 5 > 0 AS ok, p_retailprice / 10000 AS prob FROM part),
m AS (SELECT subject, greatest(max(size), 1) AS most FROM r WHERE has AND ok GROUP BY 1),
t AS (SELECT r.*, least(size::DOUBLE / coalesce(most, size), 1.0) AS tf FROM r LEFT JOIN m USING (subject))
SELECT id, round(tf, 9) AS tf, round(CASE WHEN has AND ok THEN (prob + tf + 0.25 + 0.5) / 4 ELSE 0 END, 9) AS combined_score FROM t""")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.col("p_size").alias("size"), (F.col("p_partkey") % 3 > 0).cast("int").alias("has_subjects"), (F.col("p_partkey") % 5 > 0).alias("passes"), (F.col("p_retailprice") / 10000).alias("prob"), F.lit(0.25).alias("idf"), F.lit(0.5).alias("noun_density"))
    return ranking.combined(ranking.term_frequency(rows)).select("id", F.round("tf", 9).alias("tf"), F.round("combined_score", 9).alias("combined_score"))


@query("SELECT p_partkey, CASE p_type WHEN (SELECT min(p_type) FROM part) THEN 'first' ELSE p_type END AS aspect, ((p_partkey - 1) % 4 + 4) % 4 AS device FROM part")
def aspect_and_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    least = part.agg(F.min("p_type")).first()[0]
    return part.select("p_partkey", T.aspect(F.col("p_type"), {least: "first"}).alias("aspect"), T.round_robin(F.col("p_partkey") - 1, 4).alias("device"))


@query("SELECT count(*) AS n_clusters, sum(p_size)::BIGINT AS n_sentences, (count(*) * 2)::BIGINT AS n_concepts FROM part")
def result_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.totals(table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.array("p_name", "p_type").alias("concepts")))


@query("SELECT item_id, text[:k] || '[MASK]' || text[k + 5:2 * k + 4] || '[MASK]' || text[2 * k + 8:] AS masked FROM (SELECT item_id, text, 1 + item_id % 5 AS k FROM benchmark)")
def masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (1 + F.col("item_id") % 5).cast("int")
    spans = F.array(*[F.struct(a.alias("start"), b.alias("end")) for a, b in ((2 * k + 4, 2 * k + 7), (k, k + 4))])
    return table(spark, sf_dir, "benchmark").select("item_id", T.masked(F.col("text"), spans).alias("masked"))


# Operators of the whole: listed files, exports, settings, trees, names, annotation of representatives.


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS doc_i FROM documents WHERE doc_id % 3 < 2")
def listed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three folders of annotated documents, the two that a list names, one of them twice."""
    path, docs = _folder(spark, "listed"), table(spark, sf_dir, "documents").select("doc_id")
    for k in range(3):
        files.write_annotated(docs.filter(F.col("doc_id") % 3 == k).coalesce(1).sortWithinPartitions("doc_id"), f"{path}/{k}")
    spark.createDataFrame([(f" {path}/0",), ("",), (f"{path}/1 ",), (f"{path}/0",)], "value string").coalesce(1).write.text(f"{path}/list")
    return files.listed_files(spark, f"{path}/list").select("doc_id", F.col("doc_i").cast("long").alias("doc_i"))


@query("SELECT false AS unasked, true AS there, true AS asked, false AS left_over")
def collections_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "reset")
    files.write_collection(table(spark, sf_dir, "region"), f"{path}/t", "r_regionkey")
    steps = [files.reset(spark, path), files.exists(spark, path), files.reset(spark, path, confirm=True), files.exists(spark, path)]
    return spark.createDataFrame([tuple(map(bool, steps))], "unasked boolean, there boolean, asked boolean, left_over boolean")


@query("SELECT c_custkey::VARCHAR AS id, c_nationkey::VARCHAR AS geoname_id, 'en' AS iso_language, c_name AS alternate_name, c_custkey % 2 = 0 AS is_preferred, false AS is_short FROM customer")
def alternate_names_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, key = _folder(spark, "alternates"), F.col("c_custkey")
    flags = {"is_preferred": key % 2 == 0, "is_short": F.lit(False), "is_colloquial": F.lit(False), "is_historic": F.lit(True)}
    rows = table(spark, sf_dir, "customer").select(key.cast("string").alias("alternate_name_id"), F.col("c_nationkey").cast("string").alias("geoname_id"), F.lit("en").alias("iso_language"), F.col("c_name").alias("alternate_name"), *[v.alias(k) for k, v in flags.items()], F.lit("").alias("from_date"), F.lit(None).cast("string").alias("to_date"))
    files.write_alternate_names(rows, path)
    return files.alternate_names(spark, path).select(F.col("alternate_name_id").alias("id"), "geoname_id", "iso_language", "alternate_name", "is_preferred", "is_short")


@query("SELECT c_nationkey::VARCHAR AS node_id, list_sort(list(DISTINCT c_mktsegment)) AS demonyms FROM customer GROUP BY 1")
def demonyms_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "demonyms")
    files.write_demonyms(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("node_id"), F.col("c_mktsegment").alias("demonym")), path)
    return spark.read.schema("node_id string, demonyms array<string>").json(path)


#: A file of settings in the form that nests them by component.
NESTED = """
candidate_labels: &labels [food, drink]
counter_labels: []
mongo_db: {host: localhost}
pipeline_components:
  generic_sentence_filter:
    filter: {is-short-enough: {max_length: &n 90}, has-no-pronouns: {words: [he]}}
    excluded_filters: [www]
  culture_classifier: {candidate_labels: *labels, overwrite: true, batch_size: 32}
  clustering_component: {query_db: {max_sentences: 7}, hac: {threshold: 1.25}}
  ranking_component: {rep_filter: {max_length: *n}, aspect_map: {ritual: rituals}}
"""


@query("""SELECT * FROM (VALUES ('candidate_labels', 'food,drink'), ('counter_labels', ''), ('excluded_filters', 'www'), ('max_length', '90'), ('max_sentences', '7'),
  ('overwrite_labels', 'true'), ('pronouns', 'he'), ('ward_threshold', '1.25')) AS t(name, value)""")
def settings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_settings(NESTED)
    plain = lambda v: ",".join(v) if isinstance(v, tuple) else str(v).lower()
    names = ("candidate_labels", "counter_labels", "excluded_filters", "max_length", "max_sentences", "overwrite_labels", "pronouns", "ward_threshold")
    return spark.createDataFrame([(n, plain(getattr(found, n))) for n in names], "name string, value string")


@query("SELECT * FROM (VALUES (1, 'match groups'), (2, 'filter generic sentences'), (3, 'label sentences'), (4, 'cluster sentences'), (5, 'choose representatives'), (6, 'rank assertions')) AS t(number, name)")
def stage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(int(x.split(". ")[0]), x.split(". ")[1]) for x in stages.stage_list()], "number int, name string")


@query("""WITH p AS (SELECT 'R' || r_regionkey AS node_id, 'W' AS parent_id, 1 AS level FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 2 FROM nation WHERE n_nationkey % 4 <> 0
  UNION ALL SELECT 'S' || s_suppkey, CASE WHEN n_nationkey % 4 <> 0 THEN 'N' || n_nationkey ELSE 'R' || n_regionkey END, CASE WHEN n_nationkey % 4 <> 0 THEN 3 ELSE 2 END
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0)
SELECT * FROM p UNION ALL SELECT 'W', NULL, 0""")
def place_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth nation is no place, so its suppliers climb past it; every fifth supplier is too small; a continent without parent and a place below nothing go."""
    rows = places_tree(spark, sf_dir)
    number = F.regexp_extract("node_id", "[0-9]+", 0).cast("int")
    kind = F.substring("node_id", 1, 1)
    code = F.when(kind == "R", "CONT").when((kind == "N") & (number % 4 == 0), "XXX").when(kind == "N", "PCLI").otherwise("PPL")
    people = F.when((kind == "S") & (number % 5 == 0), 999).otherwise(1000).cast("bigint")
    places = rows.select(F.col("node_id").alias("geonameid"), "name", code.alias("feature_code"), people.alias("population"), F.lit("1").alias("admin2"))
    places = places.unionByName(spark.createDataFrame([("L", "lost", "CONT", 1000, "1"), ("M", "below nothing", "PPL", 1000, "1"), ("B", "below the root", "PPL", 1000, "1")], places.schema))
    up = rows.filter("parent_id is not null").select(F.col("node_id").alias("child_id"), "parent_id").union(spark.createDataFrame([("M", "nowhere"), ("B", "W")], "a string, b string"))
    return tree.place_tree(places, up, root="W").select("node_id", "parent_id", "level")


NAMED = [("g0", "tion"), ("g0", "thin ther"), ("g1", "La Tion"), ("g2", "ing"), ("g3", "de la"), ("g4", "une")]
FORMS = [("les", "le"), ("des", "de"), ("fries", "fry"), ("unes", "une"), ("tions", "tion"), ("ases", "as")]


@query(f"""WITH {CONCEPT_SQL.split("cn AS")[0]} nm AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{a.lower()}')" for n, a in NAMED)}) AS t(node_id, alias)),
fo AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{t}')" for h, t in FORMS)}) AS t(head, tail)),
ba AS (SELECT conv_id, turn, n, CASE WHEN suffix(gram, 's') AND gram <> 'fries' THEN coalesce(tail, gram) ELSE gram END AS gram FROM ok LEFT JOIN fo ON gram = head),
kp AS (SELECT conv_id, n, gram, cnt FROM (SELECT conv_id, n, gram, count(DISTINCT turn) AS cnt FROM ba GROUP BY ALL) JOIN sz USING (conv_id) WHERE cnt / n_sentences::DOUBLE >= 0.6
  AND NOT EXISTS (SELECT 1 FROM nm WHERE node_id = 'g' || conv_id % 5 AND (contains(' ' || alias || ' ', ' ' || gram || ' ') OR list_contains(string_split(gram, ' '), alias))))
SELECT conv_id, list(gram ORDER BY cnt DESC, n, gram) AS concepts FROM kp a
WHERE NOT EXISTS (SELECT 1 FROM kp b WHERE a.conv_id = b.conv_id AND b.n > a.n AND contains(' ' || b.gram || ' ', ' ' || a.gram || ' ')) GROUP BY conv_id""")
def concepts_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts in base form, without those that hold or are part of the group's own names."""
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", F.concat(F.lit("g"), F.col("conv_id") % 5).alias("node_id"), T.surface(F.col("text")).alias("tokens"))
    names, forms = spark.createDataFrame(NAMED, "node_id string, alias string"), spark.createDataFrame(FORMS, "head string, tail string")
    return ranking.concepts(rows, ["conv_id"], GEONAMES, names, forms, ascii_only=False)


@query(f"""WITH v AS (SELECT conv_id AS doc_id, turn AS sent_i, (string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))[1] AS text FROM conversations), {NOTED_SQL.split("FROM s), ", 1)[1]}
SELECT doc_id AS conv_id, sent_i AS turn, count(*) AS n_tokens, max(root)::INT AS root, count(*) FILTER (pos = 'PROPN') AS n_entities, count(*) FILTER (i = root AND tag = 'VBZ') AS n_present FROM an GROUP BY ALL""")
def annotated_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noted(spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", T.first_sentence(F.col("text")).alias("text"))).filter(F.size("toks") > 0)
    root = F.get(F.filter("toks", lambda t: t["head"] == t["i"]), F.lit(0))
    return rows.select("conv_id", "turn", F.size("toks").cast("long").alias("n_tokens"), root["i"].alias("root"), F.size("ents").cast("long").alias("n_entities"), (root["tag"] == "VBZ").cast("long").alias("n_present"))


LEXICONS = {"food": ["the", "tion", "la"], "drink": ["de", "ing"]}


@query(f"WITH {SENT_SQL}, k AS (SELECT doc_id, sent_i, list_transform({SURFACE_SQL}, lambda x: lower(x)) AS t FROM s) SELECT doc_id, sent_i, " + ", ".join(f"len(list_filter(t, lambda x: x IN {LISTED(w)}))::DOUBLE / (len(list_filter(t, lambda x: x IN {LISTED(w)})) + 1) AS {k}" for k, w in LEXICONS.items()) + " FROM k")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent scores of labels by the lexicon provider."""
    rows = sentences(spark, sf_dir).select(F.struct("doc_id", "sent_i").alias("sentence_id"), T.surface(F.col("text")).alias("tokens"))
    scores = annotate.lexicon_scorer(LEXICONS)(rows)
    return scores.select("sentence_id.doc_id", "sentence_id.sent_i", *[F.col("scores")[k].alias(k) for k in LEXICONS])


@query()
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL; tests hold it against naive Ward linkage."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("node_id"), F.col("vec_id").alias("sentence_id"), F.col("vec_id").alias("position"), "embedding")
    return clusters.clustered(rows, 1.5)


@query()
def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL; unit tests hold the two functions against cases."""
    prepare(spark)
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.repaired(text).alias("repaired"), T.transliterated(text).alias("ascii"))
