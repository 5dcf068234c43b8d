"""Set files, group files and vector files as text, and results as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.sources.shared import written


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file in order, numbered from 0; those of a folder's files in the order of their
    names. A missing file is an error.

    A reading task takes a stretch of a file: its lines' numbers go on from those of the stretches before. The lines are read
    once and written with their stretch; one row for each stretch is all that meets in a task."""
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place")]
    lines = written(spark.read.text(path).select("value", *at), "lines")
    sizes = lines.groupBy("_file", "_start").agg(F.count("*").alias("_c"), F.min("_place").alias("_first"))
    before = F.sum("_c").over(Window.orderBy("_file", "_start")) - F.col("_c")
    offsets = sizes.select("_file", "_start", (before - F.col("_first")).alias("_shift"))
    return lines.join(F.broadcast(offsets), ["_file", "_start"]).select((F.col("_place") + F.col("_shift")).alias("line"), "value")


def _numbers(value: str) -> Column:
    parts = F.filter(F.split(F.trim(F.col(value)), r"\s+"), lambda x: x != "")
    whole = F.transform(parts, lambda x: F.when(x.rlike(r"^[+-]?\d{1,18}$"), x.try_cast("long")))
    # a line is read up to its first part that is no number
    stop = F.coalesce(F.array_position(F.transform(whole, lambda x: x.isNull()), True), F.lit(0))
    return F.when(stop > 0, F.slice(whole, F.lit(1), (stop - 1).cast("int"))).otherwise(whole)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(id, tokens) of a set file: one set of whole numbers a line, ids from 0 in order of the lines. A line ends at
    its first part that is no whole number; empty lines are empty sets."""
    return numbered_lines(spark, path).select(F.col("line").alias("id"), F.array_sort(F.array_distinct(_numbers("value"))).alias("tokens"))


def write_sets(sets: DataFrame, path: str) -> None:
    """One line for each set, in order of id."""
    sets.orderBy("id").select(F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def set_metadata(sets: DataFrame) -> DataFrame:
    """One row (cardinality, universe): the number of sets and the largest token and one."""
    return sets.agg(F.count("*").alias("cardinality"), (F.max(F.array_max("tokens")) + 1).alias("universe"))


def least_tokens(sets: DataFrame) -> DataFrame:
    """(id, least): the smallest token of each set, null for an empty one."""
    return sets.select("id", F.array_min("tokens").alias("least"))


def read_groups(spark: SparkSession, path: str, most_lines: int | None = None) -> DataFrame:
    """(group_id, id, word): one group of record ids a line, blank lines left out; id is null where a word is no whole
    number. most_lines reads the first lines only, for a file that is still being written."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    if most_lines is not None:
        lines = lines.where(F.col("line") < most_lines)
    words = lines.select(F.col("line").cast("int").alias("group_id"), F.explode(F.split(F.trim("value"), r"\s+")).alias("word"))
    return words.select("group_id", F.when(F.col("word").rlike(r"^\d{1,18}$"), F.col("word").try_cast("long")).alias("id"), "word")


def group_errors(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """(error, id): what keeps groups (group_id, id, word) from being a partition of the ids."""
    known = ids.select("id").distinct()
    none = F.lit(None).cast("long")
    bad = groups.where("id is null").select(F.lit("not a number").alias("error"), none.alias("id"))
    good = groups.where("id is not null")
    beyond = good.join(known, "id", "left_anti").select(F.lit("out of range").alias("error"), "id")
    twice = good.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("error"), "id")
    missing = known.join(good, "id", "left_anti").select(F.lit("missing").alias("error"), "id")
    return bad.unionByName(beyond).unionByName(twice).unionByName(missing)


def check_groups(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """groups (group_id, id) if they are a partition of the ids; else an error that names the first faults."""
    faults = group_errors(groups, ids).orderBy("error", "id").take(5)
    if faults or not groups.take(1):
        raise ValueError("groups are no partition of the sets: " + ("; ".join(f"{r['error']} {r['id']}" for r in faults) or "no groups"))
    return groups.select("group_id", "id")


def write_groups(groups: DataFrame, path: str) -> None:
    """One line for each group, in order; Spark's committer makes the files appear at once."""
    lines = groups.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("value"))
    lines.orderBy("group_id").select("value").write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Lines `id,v v v` of (id, vector)."""
    text = F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.transform("vector", lambda v: v.cast("string")), " "))
    vectors.select(text.alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of lines `id,v v v`."""
    parts = F.split("value", ",", 2)
    return spark.read.text(path).select(F.element_at(parts, 1).cast("long").alias("id"), F.transform(F.split(F.element_at(parts, 2), " "), lambda v: v.cast("double")).alias("vector"))


def vector_errors(vectors: DataFrame, ids: DataFrame, dims: int) -> DataFrame:
    """(error, id): duplicate, missing and badly sized vectors."""
    twice = vectors.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("error"), "id")
    missing = ids.select("id").distinct().join(vectors, "id", "left_anti").select(F.lit("missing").alias("error"), "id")
    size = vectors.where(F.size("vector") != dims).select(F.lit("dimensions").alias("error"), "id")
    return twice.unionByName(missing).unionByName(size)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], when: str | None = None) -> DataFrame:
    """stored with the rows of new in place of those of equal keys; of new rows of equal keys the last, in the order of the
    column that says when, or else of their other columns."""
    order = [F.col(c).desc_nulls_last() for c in ([when] if when else [])] + [F.col(c).desc_nulls_last() for c in new.columns if c not in keys and c != when]
    last = new.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).where("_at = 1").drop("_at")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def write_metrics(table: DataFrame, path: str) -> None:
    """A metric table as CSV with a header; missing values are empty."""
    table.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_document(document: DataFrame, path: str) -> None:
    """A result document as a text file."""
    document.select("document").write.mode("overwrite").text(path)
