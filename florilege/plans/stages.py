"""The six stages of an extraction over tables in a folder, and their runner.

Stages communicate by Parquet tables named <group>_<table>[_<facet>]; each is written once and read by the next
ones. Models are providers (see operators.annotate).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.config import Settings
from florilege.functions.text import TOKEN, surface, tokens
from florilege.operators import annotate, clusters, joins, matching, predicates, ranking
from florilege.runtime import written
from florilege.sources import files


@dataclass
class Context:
    """What stages share: where tables are, what is being extracted, and the providers."""

    spark: SparkSession
    path: str
    settings: Settings
    corpus: DataFrame | None = None  # file_path, doc_i, text, url
    nodes: DataFrame | None = None
    aliases: DataFrame | None = None
    facet: str | None = None
    node_ids: list[str] = field(default_factory=list)
    output: str | None = None
    annotator: annotate.Annotator = annotate.rule_annotator
    scorer: Callable[[DataFrame], DataFrame] | None = None
    encoder: Callable[..., DataFrame] = annotate.hashed_encoder
    summariser: clusters.Summariser | None = None
    forms: DataFrame | None = None

    def where(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{self.settings.people_group}_{name}"

    def of_facet(self, name: str) -> str:
        return f"{self.where(name)}_{self.facet}"

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def exists(self, path: str) -> bool:
        self.settle(path)
        return files.exists(self.spark, path)

    def replace(self, rows: DataFrame, path: str, *keys: str) -> None:
        """Write a table anew, also where it is read from itself: to a side path first, which is then renamed. A crash in between
        leaves the old table or the new one, which `settle` puts in its place."""
        self.settle(path)
        files.write_collection(rows, f"{path}.new", *keys, mode="overwrite")
        files.delete(self.spark, path)
        files.rename(self.spark, f"{path}.new", path)

    def settle(self, path: str) -> None:
        """Finish what a crash may have left: a whole new table takes the place of a missing one, a part of one goes."""
        if files.exists(self.spark, f"{path}.new"):
            if files.exists(self.spark, f"{path}.new/_SUCCESS") and not files.exists(self.spark, path):
                files.rename(self.spark, f"{path}.new", path)
            else:
                files.delete(self.spark, f"{path}.new")

    def all_of(self, name: str, *keys: str) -> DataFrame:
        """A table of the first two stages with what streams have added to it; a key that both have counts once."""
        path, added = self.where(name), f"{self.where(name)}_arrivals"
        self.settle(path)
        if not files.exists(self.spark, added):
            return self.read(path)
        rows = self.read(added).drop("batch").dropDuplicates(list(keys))
        return files.upsert(rows, self.read(path), *keys) if files.exists(self.spark, path) else rows

    def of_nodes(self, rows: DataFrame, wanted: bool = True) -> DataFrame:
        """rows of the requested nodes, or of the others."""
        ids = self.spark.createDataFrame([(n,) for n in sorted({*self.node_ids})], "node_id string")
        return rows.join(ids, "node_id", "left_semi" if wanted else "left_anti")


def mentions(c: Context, rows: DataFrame) -> DataFrame:
    """Matches in annotated sentences with `words`: entities for places, aliases for flat groups."""
    return matching.entity_matches(rows, c.aliases) if c.settings.people_group == "geonames" else matching.gazetteer_matches(rows, c.aliases)


def match(c: Context) -> None:
    """1: sentences with a match, and their first match of each node. Ids follow from the place of a sentence, so a rerun adds nothing twice."""
    rows = c.annotator(annotate.sentence_rows(c.corpus, repair=True)).withColumn("words", tokens(F.col("raw")))
    found = mentions(c, rows)
    c.replace(matching.first_matches(found), c.where("matches"), "sentence_id", "node_id")
    known = c.read(c.where("matches")).select("sentence_id").distinct()
    c.replace(rows.join(known, "sentence_id", "left_semi").drop("words"), c.where("sentences"), "sentence_id")


def filter_generic(c: Context) -> None:
    """2: the sentences of the corpus's files that are generic. Predicates see the raw text."""
    rows = c.all_of("sentences", "sentence_id")
    rows = rows if c.corpus is None else joins.in_files(rows, c.corpus)
    verdicts = predicates.generic(rows.withColumn("text", F.col("raw")), c.settings)
    if c.exists(c.where("generic_sentences")):
        verdicts = files.upsert(c.read(c.where("generic_sentences")), verdicts, "sentence_id")
    c.replace(verdicts, c.where("generic_sentences"), "sentence_id")


def label(c: Context) -> None:
    """3: scores of the generic sentences that have none yet (of all, on overwrite)."""
    if c.scorer is None:
        raise ValueError("labelling needs a scorer")
    rows = joins.generic_only(c.all_of("sentences", "sentence_id"), c.all_of("generic_sentences", "sentence_id"))
    done = c.exists(c.where("labels"))
    old = c.read(c.where("labels")) if done else None
    new = c.scorer(joins.not_yet(rows, old, overwrite=c.settings.overwrite_labels) if done else rows)
    c.replace(files.upsert(old, new, "sentence_id") if done else new, c.where("labels"), "sentence_id")


def cluster(c: Context) -> None:
    """4: clusters of the best sentences of each requested node for the facet; a rerun replaces the nodes' clusters."""
    labels = c.read(c.where("labels")).filter(joins.passes(F.col("scores"), c.facet, c.settings))
    labels = joins.generic_only(labels, c.all_of("generic_sentences", "sentence_id"))
    rows = joins.labelled(labels, c.all_of("sentences", "sentence_id")).select("sentence_id", "text", F.try_element_at("scores", F.lit(c.facet)).alias("score"))
    found = c.of_nodes(c.all_of("matches", "sentence_id", "node_id")).select("sentence_id", "node_id")
    best = clusters.top(rows.join(found, "sentence_id"), "score", c.settings.max_sentences)
    out = clusters.clustered(c.encoder(best).select("node_id", "sentence_id", "position", "embedding"), c.settings.ward_threshold)
    path = c.of_facet("clusters")
    if c.exists(path):
        out = c.of_nodes(c.read(path), wanted=False).select(*out.columns).unionByName(out)
    c.replace(out, path, "node_id", "cluster_rank")


def represent(c: Context) -> None:
    """5: a representative for each cluster within the limits; nodes that have some are left, or done again on overwrite."""
    path, s = c.of_facet("clusters_with_reps"), c.settings
    rows = clusters.cut(c.of_nodes(c.read(c.of_facet("clusters"))), s.cluster_limit, s.min_cluster_size)
    old = c.read(path) if c.exists(path) else None
    if old is not None:
        rows = joins.not_yet(rows, old, "node_id", s.overwrite_reps)
    rows = rows.withColumn("cluster_id", F.concat_ws(":", "node_id", F.lit(c.facet), "cluster_rank"))
    texts = joins.members(rows, c.all_of("sentences", "sentence_id").select("sentence_id", "text"))
    reps = clusters.representatives(texts, ["cluster_id"], c.summariser, s.prompt_limit)
    out = rows.join(reps, "cluster_id").select("node_id", "cluster_id", "sentence_ids", "rep")
    c.replace(files.upsert(old, out, "node_id") if old is not None else out, path, "cluster_id")


def rank(c: Context) -> None:
    """6: scored assertions of the requested nodes as JSON lines."""
    c.output = c.output or c.of_facet("assertions")
    files.write_results(assertions(c), c.output)


def assertions(c: Context) -> DataFrame:
    s, facet = c.settings, c.facet
    reps = c.of_nodes(c.read(c.of_facet("clusters_with_reps")))
    rows = ranking.candidate_reps(reps, facet, s)
    sentences = c.all_of("sentences", "sentence_id").select("sentence_id", "text", "tokens", "url")
    own = joins.members(rows.select("cluster_id", "node_id", "sentence_ids"), sentences)
    keys = ["cluster_id"]
    diverse = ranking.diversity(own, keys, s.diversity).filter("diverse").select(*keys)
    means = ranking.mean_scores(own.join(c.read(c.where("labels")), "sentence_id"), keys, facet).filter(ranking.own_facet(facet, s.cross_facet))
    listed = own.groupBy(*keys).agg(F.collect_list(F.struct("text", "url")).alias("sentences"))
    found = ranking.concepts(own, keys, s, c.aliases, c.forms)
    rows = rows.join(diverse, keys, "left_semi").join(means, keys).join(listed, keys).join(found, keys)
    rows = joins.named(rows.withColumn("size", F.size("sentence_ids")), c.nodes).withColumnRenamed("cluster_id", "id")
    noted = written(c.annotator(rows.withColumn("tokens", surface(F.col("rep")))), "annotated")
    spans = mentions(c, noted.select(F.col("id").alias("sentence_id"), tokens(F.col("rep")).alias("words"), "ents"))
    # Entities are counted in tokens as they stand, aliases in runs of letters and digits.
    spans = placed(noted.select("id", "rep"), spans.withColumnRenamed("sentence_id", "id"), TOKEN if s.people_group == "geonames" else RUN)
    noted = noted.join(spans, "id", "left").withColumn("spans", F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,end:int,text:string>>")))
    noted = noted.withColumn("has_subjects", (F.size("spans") > 0).cast("int")).withColumn("matches", F.transform("spans", lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"))))
    if s.people_group == "occupations":
        tests = ranking.without_the(noted, c.aliases)
        passes = F.col("no_the")
        for rule in ranking.occupation_filters().values():
            passes = passes & rule
        noted = tests.withColumn("passes", passes)
    else:
        noted = noted.withColumn("passes", F.lit(True))
    return ranking.score(c.encoder(noted, "rep"), facet, s, len(set(c.node_ids)))


RUN = r"[\p{L}\p{N}]+"


def placed(reps: DataFrame, spans: DataFrame, token: str = RUN) -> DataFrame:
    """id and spans (start and end in characters, text) from matches in tokens, which a pattern finds."""
    pieces = F.split(F.regexp_replace("rep", f"({token})", "\u0001$1\u0001"), "\u0001")
    words = reps.select("id", "rep", F.posexplode(pieces).alias("k", "piece"))
    at = Window.partitionBy("id").orderBy("k")
    words = words.withColumn("begin", F.coalesce(F.sum(F.length("piece")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    words = words.filter(F.col("piece").rlike(f"^(?:{token})$")).withColumn("w", (F.row_number().over(at) - 1).cast("int"))
    words = words.withColumn("finish", F.col("begin") + F.length("piece"))
    first = spans.join(words.select("id", F.col("w").alias("match_start"), "begin", "rep"), ["id", "match_start"])
    both = first.join(words.select("id", (F.col("w") + 1).alias("match_end"), "finish"), ["id", "match_end"])
    both = both.select("id", F.struct(F.col("begin").cast("int").alias("start"), F.col("finish").cast("int").alias("end"), F.substring("rep", F.col("begin") + 1, F.col("finish") - F.col("begin")).alias("text")).alias("s")).distinct()
    return both.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("spans"))


STAGES: list[tuple[str, Callable[[Context], None]]] = [
    ("match groups", match), ("filter generic sentences", filter_generic), ("label sentences", label),
    ("cluster sentences", cluster), ("choose representatives", represent), ("rank assertions", rank),
]


def stage_list() -> list[str]:
    return [f"{k}. {name}" for k, (name, _) in enumerate(STAGES, 1)]


def run(c: Context, first: int, last: int | None = None) -> None:
    """Stages first to last, in order; numbers begin with 1."""
    last = last or first
    if not 1 <= first <= last <= len(STAGES):
        raise ValueError(f"stages are 1 to {len(STAGES)}")
    if first == 1 and c.corpus is None:
        raise ValueError("matching needs a corpus")
    if last >= 4 and not (c.facet and c.node_ids):
        raise ValueError("clustering and what follows need a facet and node ids")
    if (first == 1 or last == 6) and c.aliases is None:
        raise ValueError("matching and ranking need aliases")
    for _, stage in STAGES[first - 1 : last]:
        stage(c)
