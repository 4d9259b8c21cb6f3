"""Filtering, scoring and naming clusters of sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.config import Settings
from florilege.functions.text import aspect, concept_grams, first_sentence, masked, netloc, noun_density, plural_aware, transliterated, within, without_parts
from florilege.operators import values
from florilege.operators.vectors import inverse_frequency, similar_counts

OTHER_FACETS = ("food", "drink", "clothing", "tradition", "ritual", "behaviour")


def rep_length(rep: Column, s: Settings) -> Column:
    return rep.endswith(".") & F.length(rep).between(s.min_rep_length, s.max_length)


def rep_words(rep: Column, s: Settings) -> Column:
    found = F.filter(F.split(rep, r"\s+"), lambda w: w != "")
    return (F.size(found) >= s.min_rep_tokens) & ~F.lower(F.get(found, F.lit(0))).isin(*values.BAD_REP_STARTS)


def rep_patterns(rep: Column, facet: str) -> Column:
    return ~reduce(lambda a, b: a | b, (rep.rlike(f"(?i){p}") for p in values.BY_FACET.get(facet, values.GENERAL)))


def diversity(members: DataFrame, keys: list[str], least: float = 1 / 3) -> DataFrame:
    """keys, n (sentences), n_texts, n_domains and diverse: more than one text, and texts and domains enough for the size. A missing URL is one domain, an empty one another."""
    domain = F.coalesce(F.concat(F.lit("="), netloc(F.col("url"))), F.lit("none"))
    found = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("text")).alias("n_texts"), F.countDistinct(domain).alias("n_domains"))
    return found.withColumn("diverse", (F.col("n_texts") != 1) & (F.col("n_texts") / F.col("n") >= least) & (F.col("n_domains") / F.col("n") >= least))


def mean_scores(members: DataFrame, keys: list[str], facet: str) -> DataFrame:
    """keys, prob (the mean of the facet's scores) and mean_* of the others, where a missing score is 0."""
    get = lambda k: F.try_element_at(F.col("scores"), F.lit(k))
    return members.groupBy(*keys).agg(F.avg(get(facet)).alias("prob"), *[F.avg(F.coalesce(get(k), F.lit(0.0))).alias(f"mean_{k}") for k in OTHER_FACETS])


def own_facet(facet: str, limit: float = 0.5) -> Column:
    """Whether a cluster isn't rather about another facet."""
    rivals = {"tradition": OTHER_FACETS[:3], "ritual": OTHER_FACETS[:3], "professional": OTHER_FACETS, "religious": OTHER_FACETS}.get(facet, ())
    return reduce(lambda a, b: a & b, (F.col(f"mean_{k}") <= limit for k in rivals), F.lit(True))


def concepts(members: DataFrame, keys: list[str], s: Settings, aliases: DataFrame | None = None, forms: DataFrame | None = None, ascii_only: bool = True) -> DataFrame:
    """keys and concepts: grams of 1 to max_gram tokens in a share of a cluster's sentences or more, the most frequent first (ties: fewer tokens, then the gram), without parts of longer ones.

    members: keys, tokens; with aliases also node_id, and grams that hold or are part of the node's names don't count."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sentences"))

    def sized(n: int) -> Column:
        return F.transform(concept_grams(F.col("tokens"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    each = F.flatten(F.array(*[sized(n) for n in range(1, s.max_gram + 1)]))
    extra = ["node_id"] if aliases is not None and "node_id" not in keys else []
    numbered = members.select(*keys, *extra, "tokens", F.monotonically_increasing_id().alias("_s"))  # a number for each sentence, so before the grams are
    grams = numbered.select(*keys, *extra, "_s", F.explode(each).alias("g")).select(*keys, *extra, "_s", "g.n", "g.gram")
    if ascii_only:
        grams = grams.withColumn("gram", transliterated(F.col("gram")))
    if forms is not None:
        form = forms.select(F.col("head").alias("_head"), F.col("tail").alias("_tail"))
        grams = grams.join(form, F.col("gram") == F.col("_head"), "left").withColumn("gram", plural_aware(F.col("gram"), F.col("_tail"))).drop("_head", "_tail")
    counted = grams.groupBy(*keys, *extra, "n", "gram").agg(F.countDistinct("_s").alias("cnt"))
    often = counted.join(sizes, keys).filter(F.col("cnt") / F.col("n_sentences") >= s.concept_share)
    if aliases is not None:
        own = aliases.groupBy("node_id").agg(F.collect_set(F.lower("alias")).alias("_aliases"))
        often = often.join(own, "node_id", "left")
        named = F.exists(F.coalesce("_aliases", F.array().cast("array<string>")), lambda a: within(F.col("gram"), a) | F.exists(F.split("gram", " "), lambda t: t == a))
        often = often.filter(~named).drop("_aliases")
    order = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "n", "gram")))
    listed = often.groupBy(*keys).agg(order.alias("found"))
    return listed.select(*keys, without_parts(F.array_distinct(F.transform("found", lambda x: x["gram"]))).alias("concepts"))


def occupation_filters() -> dict[str, Column]:
    """Rules on an annotated representative (toks, ents, rep); all must hold."""
    toks, rep = F.col("toks"), F.col("rep")
    none = lambda test: ~F.coalesce(F.exists(toks, test), F.lit(False))
    root = F.get(F.filter(toks, lambda t: t["head"] == t["i"]), F.lit(0))["i"]
    return {
        "start": ~F.coalesce(F.get(toks, F.lit(0))["lower"].isin(*values.OCCUPATION_STARTS), F.lit(False)),
        "entities": ~F.coalesce(F.exists("ents", lambda e: e["label"].isin(*values.OCCUPATION_ENTITIES)), F.lit(False)),
        "pronouns": none(lambda t: (t["pos"] == "PRON") & t["lower"].isin(*values.OCCUPATION_PRONOUNS)),
        "will": none(lambda t: (t["pos"] == "AUX") & (t["lower"] == "will")),
        "names": none(lambda t: t["text"].isin(*values.COMMON_NAMES)),
        "pointers": none(lambda t: t["lower"].isin("this", "these")),
        "auxiliaries": none(lambda t: (t["pos"] == "AUX") & t["lower"].isin(*values.OCCUPATION_AUXILIARIES)),
        "words": none(lambda t: t["lower"].isin(*values.OCCUPATION_WORDS)),
        "capitals": none(lambda t: (F.length(t["text"]) >= 4) & (t["text"] == F.upper(t["text"])) & (t["text"] != t["lower"])),
        "root": F.coalesce(F.size(toks) - root > 2, F.lit(False)),
        "pattern": ~rep.rlike(f"(?i){values.OCCUPATION_PATTERN}"),
    }


def without_the(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (node_id, rep) with `no_the`: whether no alias of the node follows "the", also as the start of a longer word."""
    own = aliases.filter("alias <> ''").groupBy("node_id").agg(F.collect_set(F.lower("alias")).alias("_aliases"))
    hit = F.exists(F.coalesce("_aliases", F.array().cast("array<string>")), lambda a: F.regexp_like(F.lower("rep"), F.concat(F.lit(r"\bthe \Q"), a, F.lit(r"\E"))))
    return rows.join(own, "node_id", "left").withColumn("no_the", ~hit).drop("_aliases")


def term_frequency(rows: DataFrame) -> DataFrame:
    """rows (subject, size, has_subjects, passes) with tf: size over the largest of the subject's valid rows (1 at least; one's own where there is none), 1 at most."""
    valid = (F.col("has_subjects") > 0) & F.col("passes")
    most = rows.filter(valid).groupBy(F.col("subject").alias("_subject")).agg(F.greatest(F.max("size"), F.lit(1)).alias("_most"))  # combined before the shuffle
    joined = rows.join(most, F.col("subject").eqNullSafe(F.col("_subject")), "left")
    return joined.withColumn("tf", F.least(F.try_divide(F.col("size"), F.coalesce("_most", "size")), F.lit(1.0))).drop("_subject", "_most")


def combined(rows: DataFrame) -> DataFrame:
    """rows with combined_score: the mean of prob, tf, idf and noun_density; 0 without subject or where a filter failed. It is null where idf is, so a filter on > 0 drops it."""
    mean = (F.col("prob") + F.col("tf") + F.col("idf") + F.col("noun_density")) / 4
    return rows.withColumn("combined_score", F.when((F.col("has_subjects") > 0) & F.col("passes"), mean).otherwise(0.0))


def good_concepts(rows: DataFrame, facet: str, n_requested: int, threshold: float = 0.6) -> DataFrame:
    """rows with their concepts cut to those of few enough subjects, and not on the facet's list; rows left without any stay."""
    bad = values.BAD_CONCEPTS.get(facet, [facet, f"{facet}s"])
    each = rows.select("subject", F.explode("concepts").alias("concept"))
    spread = each.groupBy("concept").agg(F.countDistinct("subject").alias("n")).filter((F.col("n") / n_requested < threshold) & ~F.col("concept").isin(*bad))
    kept = rows.select("id", F.posexplode("concepts").alias("k", "concept")).join(spread, "concept").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "concept"))).alias("_good"))
    return rows.join(kept, "id", "left").withColumn("concepts", F.coalesce(F.transform("_good", lambda x: x["concept"]), F.array().cast("array<string>"))).drop("_good")


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_sentences"), F.coalesce(F.sum(F.size("concepts")), F.lit(0)).alias("n_concepts"))


def candidate_reps(clusters: DataFrame, facet: str, s: Settings) -> DataFrame:
    """Clusters whose representative's first sentence passes the rules on its length, words and patterns; rep is that sentence."""
    rows = clusters.withColumn("rep", first_sentence(F.col("rep")))
    return rows.filter(rep_length(F.col("rep"), s) & rep_words(F.col("rep"), s) & rep_patterns(F.col("rep"), facet))


def score(rows: DataFrame, facet: str, s: Settings, n_requested: int) -> DataFrame:
    """Assertions from rows with id, subject, rep, size, prob, concepts, toks, embedding, spans, has_subjects, passes and sentences."""
    rows = rows.withColumn("noun_density", noun_density(F.col("toks")))
    named = rows.filter(F.size("concepts") > 0)
    frequency = inverse_frequency(similar_counts(named, "id", "embedding", s.idf_threshold)).select("id", "idf")
    scored = combined(term_frequency(named.join(frequency, "id")))
    scored = scored.filter("combined_score > 0")
    out = good_concepts(scored, facet, n_requested, s.concept_threshold)
    return out.select(
        "id", "subject", F.lit(s.output_domain).alias("domain"), "rep", F.col("size").cast("int").alias("size"), "prob", "tf", "idf", "noun_density", "has_subjects", "combined_score", "sentences",
        aspect(F.lit(facet), s.aspects).alias("aspect"), "concepts", masked(F.col("rep"), F.transform("spans", lambda m: F.struct(m["start"], m["end"]))).alias("masked_sentence"),
        F.transform("toks", lambda t: t["text"]).alias("tokens"), "matches",
    )
