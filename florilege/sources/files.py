"""Scans and sinks: corpora, lists, gazetteers, place files, collections and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege import schemas


def corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents of JSON lines: text, and url and timestamp where they are given. A line that doesn't parse, or a document without text, is an error."""
    docs = spark.read.schema(schemas.CORPUS).option("mode", "FAILFAST").json(list(paths))
    return docs.withColumn("text", F.coalesce("text", F.raise_error(F.lit("a document has no text"))))


def annotated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_annotated(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed lines of a text file that aren't blank: `value`."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths named by a list, each once: `file_path`."""
    return lines(spark, path).select(F.col("value").alias("file_path")).distinct()


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """The annotated documents of the files that a list names, with file_path and doc_i, their place in the file."""
    paths = [r.file_path for r in file_list(spark, path).orderBy("file_path").collect()]  # a list that a user wrote
    docs = spark.read.parquet(*paths).withColumn("file_path", F.col("_metadata.file_path"))
    return docs.withColumn("doc_i", F.row_number().over(Window.partitionBy("file_path").orderBy(F.col("_metadata.row_index"))) - 1)


def with_places(docs: DataFrame) -> DataFrame:
    """Documents of a file scan with file_path and doc_i, a number that follows from a document's file and content: it stays when files
    are split in another way or grow. Documents of a file that are equal in all columns have numbers of their own."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.withColumns({"file_path": F.col("_metadata.file_path"), "_own": own})
    nth = F.row_number().over(Window.partitionBy("file_path", "_own").orderBy("_own"))
    return rows.withColumn("doc_i", F.when(nth == 1, F.col("_own")).otherwise(F.xxhash64("_own", nth))).drop("_own")


def node_ids(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("value").alias("node_id"))


def gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (a flat tree under ROOT) and aliases of a file of names and comma-separated aliases, tabs between, with a header."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="name string, aliases string", quote="")
    rows = rows.select(F.trim("name").alias("name"), F.col("aliases")).filter("name is not null and name <> ''")
    return flat_tree(rows)


def flat_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and aliases from names and comma-separated aliases: a root, and a child for each row."""
    root = rows.sparkSession.createDataFrame([("ROOT", None, 0, "ROOT", "ROOT", 0)], schemas.NODES)
    name = F.col("name")
    nodes = root.unionByName(rows.select(name.alias("node_id"), F.lit("ROOT").alias("parent_id"), F.lit(1).alias("level"), name, name.alias("short_name"), F.lit(0).cast("bigint").alias("population")))
    parts = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda a: F.lower(F.trim(a))), lambda a: a != "")
    return nodes, rows.select(F.explode(parts).alias("alias"), name.alias("node_id")).distinct()


def _tabs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of tab-separated columns without header or quotes; a line with another number of columns is an error."""
    rows = spark.read.csv(path, sep="\t", schema=schema, quote="", mode="FAILFAST").na.fill("")
    return rows.select(*[F.trim(c).alias(c) for c in rows.columns])


def places(spark: SparkSession, path: str) -> DataFrame:
    rows = _tabs(spark, path, schemas.PLACES)
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return rows.withColumns({"population": F.coalesce(F.col("population").try_cast("int"), F.lit(0)), "alternatenames": split("alternatenames"), "cc2": split("cc2")})


def alternate_names(spark: SparkSession, path: str) -> DataFrame:
    """With flags as booleans (what doesn't parse is false) and `line`, the order in the file."""
    rows = _tabs(spark, path, schemas.ALTERNATE_NAMES).withColumn("line", F.monotonically_increasing_id())
    flags = ("is_preferred", "is_short", "is_colloquial", "is_historic")
    return rows.withColumns({c: F.coalesce(F.col(c).try_cast("int") != 0, F.lit(False)) for c in flags})


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return _tabs(spark, path, schemas.HIERARCHY).withColumn("line", F.monotonically_increasing_id())


def admin_codes(spark: SparkSession, *paths: str) -> DataFrame:
    """code and geoname_id; where files repeat a code the last wins."""
    rows = None
    for k, path in enumerate(paths):
        one = _tabs(spark, path, schemas.ADMIN_CODES).select("code", "geoname_id", F.struct(F.lit(k), F.monotonically_increasing_id()).alias("line"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("code").agg(F.max_by("geoname_id", "line").alias("geoname_id"))


def demonyms(spark: SparkSession, path: str) -> DataFrame:
    """key and demonym (or place) pairs of a JSON object of arrays, in one document."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "values")).select("key", F.explode("values").alias("value"))


def form_of(spark: SparkSession, path: str) -> DataFrame:
    """head and tail of a CSV file; the first tail of a head wins."""
    return first_by_line(spark.read.csv(path, header=True, schema="head string, tail string").withColumn("line", F.monotonically_increasing_id()), "head").select("head", "tail")


def first_by_line(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key in file order; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "line").alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest if c != "line"])


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_hierarchy(nodes: DataFrame, path: str) -> None:
    """parent, child and DERV for each node but the root."""
    nodes.filter("parent_id is not null").select("parent_id", "node_id", F.lit("DERV")).write.mode("overwrite").csv(path, sep="\t", quote="")


def write_alternate_names(rows: DataFrame, path: str) -> None:
    flag = lambda c: F.col(c).cast("int").cast("string")
    columns = ["alternate_name_id", "geoname_id", "iso_language", "alternate_name", *[flag(c).alias(c) for c in ("is_preferred", "is_short", "is_colloquial", "is_historic")], "from_date", "to_date"]
    rows.select(*columns).write.mode("overwrite").csv(path, sep="\t", quote="", emptyValue="", nullValue="")


def write_demonyms(rows: DataFrame, path: str) -> None:
    """A line for each node: its id and its distinct demonyms, as JSON."""
    rows.groupBy("node_id").agg(F.array_sort(F.collect_set("demonym")).alias("demonyms")).write.mode("overwrite").json(path)


# Collections: Parquet tables with keys.


def read_by_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def distinct_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct()


def delete_by_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """rows with new ones; a key that both have is the new one's."""
    return rows.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_absent(rows: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """rows, and new ones whose keys they lack; of several, any one whose other columns come first."""
    once = new.join(rows.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return rows.unionByName(once)


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, with an error where a key repeats: what a unique index would refuse."""
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    guard: Column = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"a key of {', '.join(keys)} repeats")).cast("boolean")).otherwise(True)
    return rows.withColumn("_n", count).filter(guard).drop("_n")


def write_collection(rows: DataFrame, path: str, *keys: str, mode: str = "error", partition: str | None = None) -> None:
    """Write a table; its keys must be unique. Partitions that a dynamic overwrite doesn't touch stay."""
    writer = (unique(rows, *keys) if keys else rows).write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _store(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    store, folder = _store(spark, path)
    return store.exists(folder)


def delete(spark: SparkSession, path: str) -> bool:
    store, folder = _store(spark, path)
    return store.delete(folder, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    store, folder = _store(spark, path)
    if not store.rename(folder, _store(spark, to)[1]):
        raise OSError(f"{path} can't be renamed to {to}")


def reset(spark: SparkSession, path: str, confirm: bool = False) -> bool:
    """Delete all collections below a folder, if confirmed; whether it did."""
    return confirm and delete(spark, path)
