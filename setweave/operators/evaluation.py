"""Relations over stored results of benchmark runs, and the plan of a benchmark.

results: dataset, label, experiment, k, concurrency, state, phase, run_date, performed, join_time, indexing_time,
size_bytes, avg_verifications, k_similarity, read_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.operators.elements import numbered

KS = (5, 10, 20, 40, 80)
CONCURRENCIES = (2, 4, 8, 16, 32)
LADDER = (1, 2, 4, 8, 16, 32)


def successful(results: DataFrame, dataset: str | None = None, prefix: str = "", field: str | None = None) -> DataFrame:
    """Finished benchmark runs, of a dataset, with a label prefix, that have a field."""
    out = results.where((F.col("state") == "success") & (F.col("phase") == "benchmark") & F.col("label").startswith(prefix))
    out = out if dataset is None else out.where(F.col("dataset") == dataset)
    return out if field is None else out.where(F.col(field).isNotNull())


def throughput(results: DataFrame) -> DataFrame:
    """results with queries a second; null where no time was taken."""
    return results.withColumn("throughput", F.when(F.col("join_time") > 0, F.col("performed") / F.col("join_time")))


def newest(results: DataFrame, *by: str) -> DataFrame:
    """One result for each key: the smallest k, of these the newest."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy("k", F.desc("run_date")))
    return results.withColumn("_at", at).where("_at = 1").drop("_at")


def median_by(results: DataFrame, value: str, *by: str) -> DataFrame:
    """(label, by..., value): the median of repeated runs."""
    return results.groupBy("label", *by).agg(F.median(value).alias(value))


def collected(medians: DataFrame, value: str, dim: str) -> DataFrame:
    """(dim, values): a map from label to value for each dimension."""
    return medians.groupBy(dim).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", value)))).alias("values"))


def metric_table(medians: DataFrame, value: str, dim: str, labels: list[str]) -> DataFrame:
    """A row for each dimension and a column for each label, empty where there is no value."""
    return medians.groupBy(dim).pivot("label", labels).agg(F.first(value))


def relative(medians: DataFrame, value: str, base: str, *dims: str, higher_is_better: bool = True) -> DataFrame:
    """medians with factor: the value against that of the base label in the same dimensions, whose own is 1; null if either
    is missing or the divisor is zero."""
    bases = medians.where(F.col("label") == base).select(*dims, F.col(value).alias("base"))
    a, b = (F.col("base"), F.col(value)) if higher_is_better else (F.col(value), F.col("base"))
    return medians.join(bases, list(dims), "left").withColumn("factor", F.when(F.col("label") == base, F.lit(1.0)).when(b != 0, a / b))


def means(factors: DataFrame, *by: str) -> DataFrame:
    """Arithmetic and geometric mean of factor; values that are not positive have no part in the latter."""
    return factors.groupBy(*by).agg(F.round(F.avg("factor"), 6).alias("arithmetic"), F.round(F.exp(F.avg(F.when(F.col("factor") > 0, F.ln("factor")))), 6).alias("geometric"))


def speed_up(medians: DataFrame, value: str, dim: str = "concurrency") -> DataFrame:
    """medians with the value over that of the label at concurrency 1."""
    first = medians.where(F.col(dim) == 1).select("label", F.col(value).alias("base"))
    return medians.join(first, "label", "left").withColumn("speed_up", F.when(F.col("base") != 0, F.col(value) / F.col("base")))


def interval_efficiency(medians: DataFrame, value: str, dim: str = "concurrency", ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(label, interval, efficiency): growth of the value from a rung of the ladder to the next, over that of the rung. An
    interval with a missing end is left out."""
    next_of = F.create_map(*[F.lit(x) for pair in zip(ladder, ladder[1:], strict=False) for x in pair])
    low = medians.select("label", F.col(dim).alias("c"), F.col(value).alias("v"), next_of[F.col(dim)].alias("d"))
    high = medians.select("label", F.col(dim).alias("d"), F.col(value).alias("w"))
    got = low.join(high, ["label", "d"]).where("v != 0")
    return got.select("label", F.concat_ws("-", F.col("c").cast("string"), F.col("d").cast("string")).alias("interval"), ((F.col("w") / F.col("v")) / (F.col("d") / F.col("c"))).alias("efficiency"))


def interval_key(interval: Column) -> Column:
    """Sorts intervals by their first number."""
    return F.split(interval, "-")[0].cast("int")


def roll_up(values: DataFrame, value: str) -> DataFrame:
    """(label, dataset, k, mean): averages by dataset, by k and over all, for each label."""
    sets = [[F.col("label"), F.col("dataset")], [F.col("label"), F.col("k")], [F.col("label")]]
    out = values.groupingSets(sets, "label", "dataset", "k").agg(F.round(F.avg(value), 6).alias("mean"))
    return out.select("label", "dataset", F.col("k").cast("int").alias("k"), "mean")


def index_matrix(results: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """Datasets by labels at k = 5, rounded, with a last row of averages."""
    m = median_by(results.where("k = 5"), value, "dataset").withColumn(value, F.round(value, 3))
    table = metric_table(m, value, "dataset", labels)
    return table.unionByName(table.agg(*[F.round(F.avg(F.col(x)), 3).alias(x) for x in labels]).select(F.lit("average").alias("dataset"), *labels))


def state_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("jobs"))


def status(jobs: DataFrame) -> DataFrame:
    """One row of counts. jobs: job, state, needs (a job that must have succeeded, or null)."""
    done = jobs.where("state = 'success'").select(F.col("job").alias("needs"), F.lit(True).alias("met"))
    j = jobs.join(done, "needs", "left").withColumn("ready", F.col("needs").isNull() | F.coalesce("met", F.lit(False)))
    n = lambda c: F.count_if(c)
    pending = F.col("state") == "pending"
    return j.agg(n(pending & F.col("ready")).alias("ready"), n(pending & ~F.col("ready")).alias("blocked"), *[n(F.col("state") == s).alias(s) for s in ("running", "success", "failed", "skipped")])


def unblocked(jobs: DataFrame) -> DataFrame:
    """Pending jobs whose prerequisite has succeeded."""
    done = jobs.where("state = 'success'").select(F.col("job").alias("needs"))
    return jobs.where("state = 'pending'").join(done, "needs", "left_semi")


def job_plan(spark: SparkSession, algorithms: list[str], datasets: list[str], sample: int = 10_000) -> DataFrame:
    """Every algorithm on every dataset at each k, and at k = 20 at each concurrency with as many more queries; one more
    neighbour is asked for, as a set finds itself. Only plain rows of names are crossed."""
    a = spark.createDataFrame([(x,) for x in algorithms], "algorithm string")
    d = spark.createDataFrame([(x,) for x in datasets], "dataset string")
    runs = [("standard", k, 1) for k in KS] + [("scalability", 20, c) for c in CONCURRENCIES]
    r = spark.createDataFrame([(e, k, k + 1, c, sample * c) for e, k, c in runs], "experiment string, requested_k int, actual_k int, concurrency int, sample_size int")
    return a.crossJoin(F.broadcast(d)).crossJoin(F.broadcast(r))


def job_order(jobs: DataFrame) -> DataFrame:
    """jobs with their place from 0 in the order in which they are claimed."""
    return numbered(jobs, "place", "stage", "memory", "algorithm", "dataset", "k")


def failure(exit_code: Column, output: Column, error: Column, limit: int = 4000) -> Column:
    """What is kept of a failed run."""
    reason = F.when(exit_code < 0, F.concat(F.lit("signal "), (-exit_code).cast("string"))).otherwise(F.concat(F.lit("exit code "), exit_code.cast("string")))
    kept = lambda x: F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("\n...[truncated]"))).otherwise(x)
    return F.struct(reason.alias("reason"), exit_code.alias("exit_code"), kept(output).alias("stdout"), kept(error).alias("stderr"))


def selected(text: str, names: list[str], presets: dict[str, list[str]]) -> list[str]:
    """The names that a comma- or blank-separated selection means, presets spelt out, each once and in order; an unknown
    one is an error."""
    out: list[str] = []
    for part in text.replace(",", " ").split():
        if part not in presets and part not in names:
            raise ValueError(f"unknown name {part!r}")
        out += presets.get(part, [part])
    return list(dict.fromkeys(out))


def exports(results: DataFrame, labels: list[str]) -> dict[str, DataFrame]:
    """The metric tables that are written as CSV, by name: medians by k of the standard runs, and throughput by concurrency."""
    ok = throughput(successful(results))
    standard, scaled = ok.where("experiment = 'standard'"), ok.where("experiment = 'scalability'")
    out = {name: metric_table(median_by(standard, column, "k"), column, "k", labels) for name, column in (("throughput", "throughput"), ("runtime", "join_time"), ("candidates", "avg_verifications"), ("k_similarity", "k_similarity"), ("read_size", "read_size"))}
    out["scalability"] = metric_table(median_by(scaled, "throughput", "concurrency"), "throughput", "concurrency", labels)
    out["index_time"] = index_matrix(standard, "indexing_time", labels)
    out["index_size"] = index_matrix(standard, "size_bytes", labels)
    return out
