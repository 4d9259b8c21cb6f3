"""Joining sentences with groups: gazetteers, entities, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import tokens


#: Bytes of aliases, as rows, up to which each executor gets them all.
FEW = 1 << 23


def normal(aliases: DataFrame) -> DataFrame:
    """node_id, alias, gram (the alias as lower-case tokens joined by blanks) and n, its tokens."""
    words = tokens(F.col("alias"))
    return aliases.select("node_id", "alias", F.array_join(words, " ").alias("gram"), F.size(words).alias("n")).filter("n > 0").dropDuplicates(["node_id", "gram"])


def gazetteer_matches(sentences: DataFrame, aliases: DataFrame) -> DataFrame:
    """sentence_id, node_id, match_text, match_start and match_end (tokens, end exclusive) of every alias in every sentence, in any case, overlaps included.

    sentences have `words`, lower-case tokens. Places whose token begins an alias are joined first, so that only they make grams, of the
    lengths that aliases with this token have; these are joined by equality. The aliases are broadcast if they are few as counted (estimates of
    what a join makes of them grow with it), so that no places and no grams are shuffled.
    """
    known = normal(aliases)
    longest, size = known.agg(F.max("n"), F.sum(F.octet_length("gram") + F.octet_length(F.col("node_id").cast("string")) + 64)).first()  # two numbers
    near = F.broadcast if (size or 0) <= FEW else lambda rows: rows
    words = F.col("words")
    if not longest:
        return sentences.select("sentence_id").limit(0).selectExpr("sentence_id", "'' as node_id", "'' as match_text", "0 as match_start", "0 as match_end")

    begins = known.groupBy(F.substring_index("gram", " ", 1).alias("first")).agg(F.collect_set("n").alias("lengths"))  # longest numbers at most
    ahead = F.transform(words, lambda _, i: F.slice(words, i + 1, longest))
    places = sentences.select("sentence_id", F.posexplode(ahead).alias("s", "ahead")).withColumn("first", F.get("ahead", F.lit(0)))
    grams = places.join(near(begins), "first").select("sentence_id", "s", "ahead", F.explode("lengths").alias("n")).filter(F.size("ahead") >= F.col("n"))
    grams = grams.select("sentence_id", "s", "n", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("gram"))
    found = grams.join(near(known.select("node_id", "gram")), "gram")
    return found.select("sentence_id", "node_id", F.col("gram").alias("match_text"), F.col("s").alias("match_start"), (F.col("s") + F.col("n")).alias("match_end"))


def entity_matches(annotated: DataFrame, aliases: DataFrame, labels: tuple[str, ...] = ("NORP", "GPE")) -> DataFrame:
    """Entities with one of the labels whose text is an alias."""
    ents = annotated.select("sentence_id", F.explode("ents").alias("e")).filter(F.col("e.label").isin(*labels))
    ents = ents.select("sentence_id", F.lower(F.trim("e.text")).alias("alias"), F.col("e.text").alias("match_text"), F.col("e.start").alias("match_start"), F.col("e.end").alias("match_end"))
    return ents.join(best_nodes(aliases), "alias").select("sentence_id", "node_id", "match_text", "match_start", "match_end")


def best_nodes(aliases: DataFrame) -> DataFrame:
    """alias and node_id of each alias's best node: highest population, then lowest level, then first id. Nodes without these columns go by id."""
    for column, value in (("population", 0), ("level", 0)):
        if column not in aliases.columns:
            aliases = aliases.withColumn(column, F.lit(value))
    order = F.struct((-F.coalesce("population", F.lit(0))).alias("p"), F.col("level"), F.col("node_id"))
    return aliases.groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.min_by("node_id", order).alias("node_id"))


def node_of(mentions: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """mentions with node_id of the best node of an alias in a column; unknown aliases get null instead of an error."""
    best = best_nodes(aliases).withColumnRenamed("alias", "_alias")
    return mentions.join(best, F.lower(F.trim(F.col(column))) == F.col("_alias"), "left").drop("_alias")


def first_matches(matches: DataFrame) -> DataFrame:
    """The first span of each node in each sentence, by start, then end."""
    first = matches.groupBy("sentence_id", "node_id").agg(F.min(F.struct("match_start", "match_end", "match_text")).alias("m"))
    return first.select("sentence_id", "node_id", "m.match_text", "m.match_start", "m.match_end")


def with_matches(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """rows with `matches`, the array of their matches in order (empty if none)."""
    grouped = matches.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("match_start", "match_end", "node_id", "match_text"))).alias("matches"))
    return rows.join(grouped, "sentence_id", "left")


def any_match(rows: DataFrame, matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows of sentences with a match of any of the nodes."""
    return rows.join(matches.join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("sentence_id").distinct(), "sentence_id", "left_semi")


def ranked(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each key in an order that has no ties; Spark prunes within tasks before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= limit)
