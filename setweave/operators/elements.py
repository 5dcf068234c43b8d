"""Collections of sets: from (id, token) rows to elements in rarest-first order, and their statistics.

The element form is one row (id, token, freq, pos, n) for each token of a set: freq is the number of sets with the token,
pos its place in its set when tokens go from rare to common, n the set's size. Ranks over the whole universe are only
dealt where a dense number is asked for; the order (freq, token) says the same and needs no global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.sources.shared import written


def distinct_pairs(rows: DataFrame, id_col: str, token_col: str) -> DataFrame:
    """(id, token) without nulls or repetitions."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(token_col).alias("token")).where("id is not null and token is not null").distinct()


def validate_tokens(pairs: DataFrame) -> DataFrame:
    """pairs, failing on a negative token."""
    return pairs.withColumn("token", F.when(F.col("token") < 0, F.raise_error(F.concat(F.lit("negative token "), F.col("token").cast("string")))).otherwise(F.col("token")))


def token_frequency(pairs: DataFrame) -> DataFrame:
    """(token, freq): in how many sets each token stands."""
    return pairs.groupBy("token").agg(F.count("*").alias("freq"))


def numbered(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """rows with the number from 0 of each in the order of some columns, of any type, which should tell all rows apart.

    The rows are dealt to ranges of that order and written; each row has its place in its range, and the ranges' sizes, summed
    before each, are the offsets. One row for each range is all that meets in a task."""
    dealt = written(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_c"))
    before = sizes.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return dealt.withColumn("_row", at).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_range", "_before", "_row")


def dense_rank_by(rows: DataFrame, major: str, minor: str, name: str) -> DataFrame:
    """rows with the number from 0 of each in the order of (major, minor); minor is unique within major."""
    return numbered(rows, name, major, minor)


def token_rank(pairs: DataFrame) -> DataFrame:
    """(token, freq, rank): rank 0 is the rarest token, ties by token."""
    return dense_rank_by(token_frequency(pairs), "freq", "token", "rank")


def elements(pairs: DataFrame) -> DataFrame:
    """(id, token, freq, pos, n) of distinct (id, token) rows."""
    by_set = Window.partitionBy("id")
    rows = pairs.join(token_frequency(pairs), "token")
    return rows.select("id", "token", "freq", (F.row_number().over(by_set.orderBy("freq", "token")) - 1).cast("int").alias("pos"), F.count("*").over(by_set).cast("int").alias("n"))


def sets(elems: DataFrame) -> DataFrame:
    """(id, n, tokens): the array form, tokens in ascending order."""
    return elems.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list("token")).alias("tokens"))


def explode_sets(rows: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """Distinct (id, token) rows of an array form; empty sets vanish."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array_distinct(F.col(tokens_col))).alias("token")).where("token is not null")


def relabel(pairs: DataFrame) -> DataFrame:
    """(id, token) with tokens renamed to their ranks."""
    return pairs.join(token_rank(pairs), "token").select("id", F.col("rank").alias("token"))


def renumber_by_size(elems: DataFrame) -> DataFrame:
    """(id, n, number): sets numbered from 0 by size, then id."""
    return dense_rank_by(elems.groupBy("id").agg(F.count("*").alias("n")), "n", "id", "number")


def size_index(numbers: DataFrame) -> DataFrame:
    """(n, first, sets): of sets numbered by size, the first number of each size and how many there are."""
    return numbers.groupBy("n").agg(F.min("number").alias("first"), F.count("*").alias("sets"))


def universe_stats(pairs: DataFrame) -> DataFrame:
    """One row: sets, tokens, average size, distinct tokens, largest token and the sum of squared frequencies."""
    freq = token_frequency(pairs).agg(F.count("*").alias("universe"), F.sum(F.col("freq") * F.col("freq")).alias("pair_volume"), F.max("token").alias("max_token"), F.sum("freq").alias("tokens"))
    count = pairs.agg(F.count_distinct("id").alias("sets"))
    return freq.crossJoin(count).select("sets", "tokens", (F.col("tokens") / F.col("sets")).alias("avg_size"), "universe", "max_token", "pair_volume")


def length_histogram(elems_or_pairs: DataFrame) -> DataFrame:
    """(n, sets, weight): how many sets have each size, and their tokens together."""
    return elems_or_pairs.groupBy("id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sets"), F.sum("n").alias("weight"))


def hash_sample(ids: DataFrame, percent: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """About percent of a hundred of the ids, the same in every run and on every engine: by the digest of id and seed."""
    return ids.where(F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent)


def draw_queries(ids: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n ids drawn uniformly with replacement, as rows (draw, id) in order of id: ranks are drawn and joined."""
    ranked = written(numbered(ids.select(F.col(id_col).alias("id")).distinct(), "_rank", "id"), "ranked")
    total = ranked.count()
    draws = ids.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("_rank"))
    return draws.join(ranked, "_rank").select("draw", "id")
