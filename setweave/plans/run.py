"""One nearest-neighbour run: from a set file to a result document."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from setweave.config import ALGORITHMS, GROUPINGS, MODES, SUFFIX_DEPTHS, KnnConfig
from setweave.operators import elements as E
from setweave.operators import knn
from setweave.operators import statistics as S
from setweave.sources import files
from setweave.sources.shared import written

#: The grouping of the length groups of plans that fix it; None stands for the configuration's.
LENGTH_GROUPED = {"slim": None, "full": None, "eager": "identity", "grouping": "wsqrt"}
#: Plans over one list of sets for each token.
TOKEN_LISTS = ("baseline", "baselinepp", "topkbaseline")


class TimedOut(Exception):
    """A run took longer than its timeout; its jobs are cancelled."""


def within(spark: SparkSession, seconds: float, action):
    """What the action returns; if it takes longer than so many seconds (0: any time) its jobs are cancelled, those too that
    it starts after that."""
    if not seconds:
        return action()
    tag, late, done = f"setweave-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while not done.is_set():
            spark.sparkContext.cancelJobsWithTag(tag)
            done.wait(0.2)

    spark.sparkContext.addJobTag(tag)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception:
        if late.is_set():
            raise TimedOut(f"the run took more than {seconds} seconds") from None
        raise
    finally:
        done.set()
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def index_statistics(elems: DataFrame, config: KnnConfig, groups: DataFrame | None = None) -> dict:
    """What the index of the configured plan holds: the lengths of its lists, and of plans with length groups their number and
    the histogram of sizes by group. Other plans have no lists by token; of les3 the groups are counted."""
    if config.algorithm == "les3":
        return {"group_count": groups.select("group_id").distinct().count()}
    if config.algorithm not in (*LENGTH_GROUPED, *TOKEN_LISTS):
        return {}
    grouped = config.algorithm in LENGTH_GROUPED
    bounds = knn.grouping_of(elems, (LENGTH_GROUPED[config.algorithm] or config.grouping) if grouped else "aio")
    out = {"list_size": S.list_sizes(elems, bounds).first().asDict()}
    if grouped:
        rows = S.group_histogram(E.length_histogram(elems), bounds).orderBy("size").collect()  # a row for each size
        out |= {"group_count": bounds.count(), "group_histogram": [r.asDict() for r in rows]}
    return out


def run(spark: SparkSession, path: str, config: KnnConfig, output: str | None = None) -> dict:
    """Reads the sets, optionally relabels them, answers the queries, and returns the document {meta, statistics}. With an
    output path the result rows are written there as Parquet, those of a query once however often it is drawn.

    Tokens and elements are written before the next step begins, so each time is that of its own work. Queries are drawn of
    all sets, with replacement; a repeated one counts as often as it is drawn, an empty set is a query without matches."""
    sets = files.read_sets(spark, path)
    began = time.time()
    pairs = E.validate_tokens(E.explode_sets(sets))
    if config.preprocess:
        pairs = written(E.relabel(pairs), "relabelled")
    prepared = time.time()
    elems = written(E.elements(pairs), "elements")
    groups = written(files.check_groups(files.read_groups(spark, config.groups), sets), "groups") if config.groups else None
    indexed = time.time()
    asked = written(E.draw_queries(sets, config.sample_size, config.seed), "drawn") if config.mode == "sample" else sets.select("id")
    timed_out, state = False, None

    def answer() -> Row:
        result: DataFrame = knn.search(elems, config, asked if config.mode == "sample" else None, groups)
        if output:
            result.write.mode("overwrite").parquet(output)
            result = spark.read.parquet(output)
        kth = knn.kth_similarity(result, config.k).withColumnRenamed("query_id", "id")
        each = asked.select("id").join(kth, "id", "left")
        return each.agg(F.count("*").alias("performed"), F.avg(F.coalesce("kth", F.lit(0.0))).alias("kth"), F.sum("matches").alias("matches")).first()

    try:
        state = within(spark, config.timeout, answer)
    except TimedOut:
        timed_out = True
    ended = time.time()
    size = sets.agg(F.count("*")).first()[0]
    requested = size if config.mode == "join" else config.sample_size
    meta = {"date": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "dataset": path, "cardinality": size, "k": config.k, "algorithm": config.algorithm, "mode": config.mode, "preprocess": config.preprocess, "timeout": config.timeout, "size_grouping": config.grouping, "suffix_depth": config.suffix_depth, "sketch_vec": config.fingerprint, "label": config.label, "outer_time": ended - began}
    meta |= {"sample_size": config.sample_size, "seed": config.seed} if config.mode == "sample" else {}
    join = {"queries": {"requested": requested, "performed": state["performed"] if state else 0, "timed_out": timed_out}, "final_k_similarity": state["kth"] if state else None, "final_heap_size": state["matches"] if state else None}
    timing = {"preprocessing_time": prepared - began, "indexing_time": indexed - prepared, "join_time": ended - indexed}
    return {"meta": meta, "statistics": {"join": join, "index": index_statistics(elems, config, groups), "timing": timing}}


def parser() -> argparse.ArgumentParser:
    """The command line of a run."""
    p = argparse.ArgumentParser(prog="setweave", description="k nearest sets by Jaccard similarity")
    p.add_argument("-f", "--input-file", required=True)
    p.add_argument("-k", "--top-k", type=int, required=True)
    p.add_argument("-a", "--algorithm", choices=ALGORITHMS, default="slim")
    p.add_argument("--les3-groups")
    p.add_argument("--puffinn-recall", type=float, default=0.95)
    p.add_argument("-s", "--sample-size", type=int, default=10_000)
    p.add_argument("-t", "--timeout", type=float, default=0)
    p.add_argument("-r", "--seed", type=lambda x: int(x, 0), default=0x42424242)
    p.add_argument("-m", "--mode", choices=MODES, default="sample")
    p.add_argument("-x", "--suffix", type=int, choices=SUFFIX_DEPTHS, default=0)
    p.add_argument("-v", "--vector", type=int, default=0)
    p.add_argument("-l", "--label", default="")
    p.add_argument("-g", "--length-grouping", choices=GROUPINGS, default="identity")
    p.add_argument("-d", "--deletion", action="store_true")
    p.add_argument("--preprocess", action="store_true")
    p.add_argument("-o", "--output", help="folder for the result rows")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        config = KnnConfig(k=a.top_k, algorithm=a.algorithm, grouping=a.length_grouping, mode=a.mode, sample_size=a.sample_size, seed=a.seed, timeout=a.timeout, suffix_depth=a.suffix, fingerprint=a.vector != 0, deletion=a.deletion, preprocess=a.preprocess, groups=a.les3_groups, recall=a.puffinn_recall, label=a.label)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    print(json.dumps(run(spark, a.input_file, config, a.output), indent=2))
    return 0
