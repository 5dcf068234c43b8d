"""Statistics of runs and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.functions import bounds as B
from setweave.functions.grouping import with_group
from setweave.operators.knn import kth_similarity


def average_item(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Sum, count, least, most and average of a value; zeros for no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(*by).agg(zero(F.sum(value)).alias("sum"), F.count(value).alias("count"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"), zero(F.avg(value)).cast("double").alias("avg"))


def list_sizes(elems: DataFrame, bounds: DataFrame) -> DataFrame:
    """average_item of the lengths of the lists of an inverted index by length group and token."""
    lists = with_group(elems, bounds).groupBy("grp", "token").agg(F.count("*").alias("length"))
    return average_item(lists, "length")


def group_histogram(histogram: DataFrame, bounds: DataFrame) -> DataFrame:
    """(size, count, weight, group): the histogram of sizes as it is exported, with the length group of each size."""
    return with_group(histogram, bounds).select(F.col("n").alias("size"), F.col("sets").alias("count"), "weight", F.col("grp").alias("group"))


def event_bounds(sizes: DataFrame, bounds: DataFrame) -> DataFrame:
    """(n_q, grp, pos, bound): the best similarity of a query of a size to a group's sets whose first common token is at
    a position; the positions of the query and every group. Both tables have a row for each distinct size at most."""
    grid = sizes.select(F.col("n").alias("n_q")).crossJoin(F.broadcast(bounds.select("grp", "lo", "hi")))
    grid = grid.withColumn("pos", F.explode(F.sequence(F.lit(0), (F.col("n_q") - 1).cast("int")))).withColumn("pos", F.col("pos").cast("long"))
    reach = F.col("hi") >= F.col("n_q") - F.col("pos")
    top = F.least(F.col("n_q") - F.col("pos"), F.col("hi"))
    bound = F.when(reach, B.group_bound("n_q", "pos", "lo")).otherwise(top / (F.col("n_q") + F.col("hi") - top))
    return grid.select("n_q", "grp", "pos", bound.alias("bound"))


def signature_cost_order(signatures: DataFrame) -> DataFrame:
    """(id, cls, sig, cost, place): a set's class signatures from the one that fewest sets have to the most common."""
    cost = signatures.groupBy("cls", "sig").agg(F.count("*").alias("cost"))
    return signatures.join(cost, ["cls", "sig"]).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("cost", "cls"))).select("id", "cls", "sig", "cost", "place")


def join_statistics(result: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """One row: queries performed, candidate pairs, matches returned, and the average k-th similarity."""
    pre = candidates.agg(F.count("*").alias("precandidates"))
    kth = kth_similarity(result, k).agg(F.count("*").alias("queries"), F.sum("matches").alias("matches"), F.avg("kth").alias("final_k_similarity"))
    return kth.crossJoin(pre)


def result_document(meta: dict, statistics: DataFrame) -> DataFrame:
    """One row (document): the run's description and statistics as JSON."""
    fields: list[Column] = [F.lit(v).alias(k) for k, v in meta.items()]
    return statistics.select(F.to_json(F.struct(F.struct(*fields).alias("meta"), F.struct(*statistics.columns).alias("statistics"))).alias("document"))
