"""python -m florilege --group religions --tables DIR [--corpus FILE] [--gazetteer FILE] --stages 1 6 ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from florilege.config import PRESETS, read_settings
from florilege.operators.annotate import lexicon_scorer
from florilege.operators.tree import place_groups
from florilege.plans.stages import Context, run, stage_list
from florilege.runtime import prepare
from florilege.sources import files


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="florilege", description="Stages: " + "; ".join(stage_list()))
    p.add_argument("--group", choices=sorted(PRESETS), default="religions")
    p.add_argument("--config", help="a YAML file of settings; overrides --group")
    p.add_argument("--tables", required=True, help="the folder of all tables")
    p.add_argument("--corpus", nargs="*", help="JSON lines with text and perhaps url and timestamp")
    p.add_argument("--gazetteer", help="names and aliases, for flat groups")
    p.add_argument("--places", help="the file of places, for a place hierarchy; with --hierarchy")
    p.add_argument("--hierarchy")
    p.add_argument("--admin", nargs="*", help="files of administrative codes")
    p.add_argument("--alternate-names")
    p.add_argument("--demonyms", help="a JSON object: node id to demonyms")
    p.add_argument("--raw-demonyms", help="a JSON object: demonym to places")
    p.add_argument("--stages", nargs="+", type=int, default=[1], help="one stage, or a first and a last")
    p.add_argument("--facet")
    p.add_argument("--ids", help="a file of node ids")
    p.add_argument("--lexicon", help="a JSON object of arrays: the words of each label, for the offline scorer")
    p.add_argument("--output")
    p.add_argument("--reset", action="store_true", help="delete all tables of the folder, and do nothing else")
    a = p.parse_args(arguments)
    spark = prepare(SparkSession.builder.getOrCreate())
    if a.reset:
        print("deleted" if files.reset(spark, a.tables, confirm=input("Delete all tables? [y/N] ").lower() == "y") else "left")
        return
    settings = read_settings(a.config) if a.config else PRESETS[a.group]
    corpus = None
    if a.corpus:
        corpus = files.with_places(files.corpus(spark, *a.corpus))
    nodes, aliases = files.gazetteer(spark, a.gazetteer) if a.gazetteer else (None, None)
    if a.places:
        read = lambda path, reader: reader(spark, path) if path else None
        admin = files.admin_codes(spark, *a.admin) if a.admin else None
        nodes, aliases = place_groups(files.places(spark, a.places), files.hierarchy(spark, a.hierarchy), admin, read(a.alternate_names, files.alternate_names), read(a.demonyms, files.demonyms), read(a.raw_demonyms, files.demonyms))
    lexicon = {r.key: r.words for r in files.demonyms(spark, a.lexicon).groupBy("key").agg(F.collect_list("value").alias("words")).collect()} if a.lexicon else None
    ids = [r.node_id for r in files.node_ids(spark, a.ids).collect()] if a.ids else []
    run(Context(spark, a.tables, settings, corpus, nodes, aliases, a.facet, ids, a.output, scorer=lexicon_scorer(lexicon) if lexicon else None), a.stages[0], a.stages[-1])


if __name__ == "__main__":
    main()
