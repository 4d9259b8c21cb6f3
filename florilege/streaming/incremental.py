"""Incremental runs: new documents are matched and filtered as they arrive, each sentence once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from florilege.functions.text import tokens
from florilege.operators import annotate, matching, predicates
from florilege.plans.stages import Context, mentions


def arrivals(c: Context, docs: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the sentences, matches and verdicts of each batch of a stream of documents (file_path, doc_i, text, url).

    A batch writes to a partition of its own, by overwrite: a batch that is run again replaces what it had written. The stages
    from the second on read these tables together with those of the first."""

    def take(batch: DataFrame, number: int) -> None:
        own = replace(c, corpus=batch)
        rows = own.annotator(annotate.sentence_rows(batch, repair=True)).withColumn("words", tokens(F.col("raw")))
        found = matching.first_matches(mentions(own, rows))
        known = rows.join(found.select("sentence_id").distinct(), "sentence_id", "left_semi").drop("words")
        verdicts = predicates.generic(known.withColumn("text", F.col("raw")), own.settings)
        for name, part in (("matches", found), ("sentences", known), ("generic_sentences", verdicts)):
            part.write.mode("overwrite").parquet(f"{own.where(name)}_arrivals/batch={number}")

    writer = docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
