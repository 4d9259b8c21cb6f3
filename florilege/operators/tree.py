"""Trees of groups: place hierarchies, ancestors, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.runtime import written
from florilege.sources.files import first_by_line

#: The feature codes that make a node, and the root of all places.
FEATURES = ("CONT", "PCL", "PCLD", "PCLF", "PCLH", "PCLI", "PCLIX", "PCLS", "ADM1", "ADM2", "ADM3", "PPLA", "PPLA2", "PPLAG", "PPLC", "PPL")
EARTH, CONTINENT, FEWEST = "6295630", "CONT", 1000
#: Endings of demonyms that take no s, and languages that are no language.
NO_PLURAL = ("s", "ese", "sh", "ch", "x", "y", "z", "man")
NO_NAME = ("link", "wkdt")


def features(places: DataFrame) -> DataFrame:
    """The places that can be nodes."""
    small = (F.col("feature_code") == "PPL") & (F.col("population") < FEWEST)
    vague = F.col("feature_code").isin("PPLA2", "ADM3") & F.col("admin2").isin("", "00")
    return places.filter(F.col("feature_code").isin(*FEATURES) & ~small & ~vague)


def parents(places: DataFrame, hierarchy: DataFrame, admin: DataFrame | None = None) -> DataFrame:
    """child_id and parent_id: the first parent in the hierarchy, else the administrative unit of the place's codes; no place is its own parent."""
    known = first_by_line(hierarchy.select("child_id", "parent_id", "line"), "child_id")
    if admin is not None:
        fine = F.concat_ws(".", "country_code", "admin1", "admin2")
        code = F.when(F.col("admin2").isin("", "00"), F.concat_ws(".", "country_code", "admin1")).otherwise(fine)
        orphans = places.select(F.col("geonameid").alias("child_id"), code.alias("code")).join(known, "child_id", "left_anti")
        known = known.unionByName(orphans.join(admin, "code").select("child_id", F.col("geoname_id").alias("parent_id")))
    return known.filter("child_id <> parent_id")


def nearest(nodes: DataFrame, up: DataFrame, tries: int = 11) -> DataFrame:
    """node_id and parent_id: the nearest ancestor that is a node, at most `tries` hops above the first parent. Nodes without one are absent.

    nodes: node_id; up: child_id, parent_id of all known, node or not. The loop is over depth, each round a join of what is still open."""
    present = nodes.select(F.col("node_id").alias("present")).distinct()
    above = up.select(F.col("child_id").alias("at"), F.col("parent_id").alias("next"))
    open_ = nodes.select("node_id").join(up.withColumnRenamed("child_id", "node_id"), "node_id").select("node_id", F.col("parent_id").alias("at"))
    done = None
    for _ in range(tries + 1):
        tested = open_.join(present, F.col("at") == F.col("present"), "left")
        hit = tested.filter("present is not null").select("node_id", F.col("at").alias("parent_id"))
        done = hit if done is None else done.unionByName(hit)
        open_ = written(tested.filter("present is null").select("node_id", "at").join(above, "at").select("node_id", F.col("next").alias("at")), "climb")
        if open_.isEmpty():
            break
    return done


def place_tree(places: DataFrame, up: DataFrame, root: str = EARTH, tries: int = 11) -> DataFrame:
    """Nodes with parent_id and level: features under their nearest existing ancestors. Nodes whose ancestor is the root but are no
    continent, and nodes that reach none, go; what was below a removed node climbs past it, whatever the order of the file."""
    kept = features(places).filter(F.col("geonameid") != root).select(F.col("geonameid").alias("node_id"), "feature_code", "name", F.col("name").alias("short_name"), "population")
    base = places.filter(F.col("geonameid") == root).select(F.col("geonameid").alias("node_id"), F.lit("").alias("feature_code"), "name", F.col("name").alias("short_name"), "population")
    while True:
        linked = nearest(kept.select("node_id").unionByName(base.select("node_id")), up, tries).filter(F.col("node_id") != root)
        placed = kept.join(linked, "node_id").filter((F.col("parent_id") != root) | (F.col("feature_code") == CONTINENT))
        placed = written(placed, "placed")
        if placed.count() == kept.count():
            break
        kept = placed.drop("parent_id")
    rooted = base.withColumn("parent_id", F.lit(None).cast("string")).unionByName(placed)
    return levels(rooted.drop("feature_code"), root)


def levels(nodes: DataFrame, root: str) -> DataFrame:
    """nodes with their level below the root; nodes that don't hang from it (cycles) go. One join a level."""
    wave = nodes.filter(F.col("node_id") == root).select("node_id").withColumn("level", F.lit(0))
    found = wave
    edges = nodes.select("node_id", "parent_id").filter(F.col("node_id") != root)
    while not wave.isEmpty():
        wave = written(edges.join(wave.select(F.col("node_id").alias("parent_id"), "level"), "parent_id").select("node_id", (F.col("level") + 1).alias("level")), "wave")
        found = found.unionByName(wave)
    return nodes.drop("level").join(written(found, "levels"), "node_id")


def paths(nodes: DataFrame) -> DataFrame:
    """node_id and path, the names from the root down to each node."""
    root = nodes.filter("parent_id is null").select("node_id", F.array("name").alias("path"))
    wave, found = root, root
    while not wave.isEmpty():
        below = wave.select(F.col("node_id").alias("parent_id"), "path")
        wave = written(nodes.join(below, "parent_id").select("node_id", F.concat("path", F.array("name")).alias("path")), "paths")
        found = found.unionByName(wave)
    return found


def printed(path: Column, indent: int = 2) -> Column:
    """A path as lines, each level indented further."""
    return F.array_join(F.transform(path, lambda name, k: F.concat(F.repeat(F.lit(" "), k * indent), name)), "\n")


def short_names(nodes: DataFrame, alternates: DataFrame) -> DataFrame:
    """nodes with short_name: the first English preferred alternate name, else the name."""
    first = alternates.filter("iso_language = 'en' and is_preferred").groupBy("geoname_id").agg(F.min_by("alternate_name", "line").alias("_short"))
    return nodes.join(first, F.col("node_id") == F.col("geoname_id"), "left").withColumn("short_name", F.coalesce("_short", "name")).drop("_short", "geoname_id")


def plurals(demonyms: Column) -> Column:
    """Plurals of demonyms: s, or men for man; others have none, but for Czech."""
    ends = lambda d: F.exists(F.array(*[F.lit(e) for e in NO_PLURAL]), lambda e: d.endswith(e))
    plain = F.transform(F.filter(demonyms, lambda d: ~ends(d)), lambda d: F.concat(d, F.lit("s")))
    men = F.transform(F.filter(demonyms, lambda d: d.endswith("man")), lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 3), F.lit("men")))
    return F.concat(plain, men, F.when(F.array_contains(demonyms, "Czech"), F.array(F.lit("Czechs"))).otherwise(F.array().cast("array<string>")))


def alternates_of(nodes: DataFrame, alternates: DataFrame) -> DataFrame:
    """node_id and names: the alternate names of nodes, without links."""
    own = alternates.filter(~F.col("iso_language").isin(*NO_NAME)).join(nodes.select(F.col("node_id").alias("geoname_id")), "geoname_id", "left_semi")
    return own.groupBy(F.col("geoname_id").alias("node_id")).agg(F.collect_set("alternate_name").alias("names"))


def alias_sets(names: Column, demonyms: Column) -> Column:
    """The aliases of a node: its names, demonyms and their plurals, trimmed and in lower case."""
    return F.filter(F.array_distinct(F.transform(F.concat(names, demonyms, plurals(demonyms)), lambda a: F.lower(F.trim(a)))), lambda a: a != "")


def attach_demonyms(aliases: DataFrame, raw: DataFrame) -> DataFrame:
    """node_id and demonyms from (key = demonym, value = place) pairs: each place's best node gets them."""
    from florilege.operators.matching import best_nodes

    places = raw.select(F.lower(F.trim("value")).alias("alias"), F.col("key").alias("demonym"))
    return places.join(best_nodes(aliases), "alias").groupBy("node_id").agg(F.array_sort(F.collect_set("demonym")).alias("demonyms"))


def alias_counts(aliases: DataFrame) -> DataFrame:
    """n_aliases (distinct) and n_entries."""
    return aliases.agg(F.countDistinct("alias").alias("n_aliases"), F.count(F.lit(1)).alias("n_entries"))


def nodes_by_alias(aliases: DataFrame, alias: str) -> DataFrame:
    return aliases.filter(F.col("alias") == alias.lower().strip())


def place_groups(places: DataFrame, hierarchy: DataFrame, admin: DataFrame | None = None, alternates: DataFrame | None = None, processed: DataFrame | None = None, raw: DataFrame | None = None, root: str = EARTH) -> tuple[DataFrame, DataFrame]:
    """Nodes and aliases (alias, node_id, population, level) of a place hierarchy, from the tables that sources.files reads.

    processed demonyms are pairs (node id, demonym); raw ones (demonym, place) are used where no processed ones are given.
    """
    nodes = written(place_tree(places, parents(places, hierarchy, admin), root), "nodes")
    own = places.select(F.col("geonameid").alias("node_id"), F.concat(F.array("name", "asciiname"), "alternatenames").alias("names"))
    rows = nodes.join(own, "node_id")
    if alternates is not None:
        nodes = short_names(nodes, alternates)
        more = alternates_of(nodes, alternates).withColumnRenamed("names", "_more")
        rows = nodes.join(own, "node_id").join(more, "node_id", "left").withColumn("names", F.concat("names", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")
    none = F.array().cast("array<string>")

    def entries(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(alias_sets(F.col("names"), F.coalesce("demonyms", none))).alias("alias"), "node_id", "population", "level")

    given = None
    if processed is not None:
        given = processed.groupBy(F.col("key").alias("node_id")).agg(F.collect_set("value").alias("demonyms"))
    elif raw is not None:
        given = attach_demonyms(entries(rows.withColumn("demonyms", none)), raw)
    rows = rows.withColumn("demonyms", none) if given is None else rows.join(given, "node_id", "left")
    return nodes.select("node_id", "parent_id", "level", "name", "short_name", F.col("population").cast("bigint").alias("population")), entries(rows)
