"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants the same, usually fractional, number of copies. Two documents at a time
pass mass (copies times size) from one to the other, in a direction drawn so that neither's expectation
changes, until one of them has a whole number. The words that a source takes thus stay at its target. Blocks
of documents are rounded independently; each leaves at most one fractional document, and those of many blocks
are rounded against each other in the next level of a reduction tree, until one a source is left and drawn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.llm.frames import free, named, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents of a block, and residuals that one task of the reduction tree combines.
BLOCK, FAN = 4096, 4096

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target) from one row (source, source_size, n) for each source.

    Sources in code-point order, null last, get the weights in turn and share `share` of all sizes; a target
    ends at `most` times its source's size and the excess is reshared by weight: target = min(most * size, level *
    weight), where the level makes the targets add up. Only the sources' totals meet in one task."""
    order, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_fill", "_rank")
    s = sizes.withColumn("_rank", F.row_number().over(order) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size")).withColumn("_fill", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_rank", "_level"))).over(every)["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return s.select("source", "source_size", "n", F.col("_rank").alias("source_rank"), target.cast("double").alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds the fractional parts (each strictly between 0 and 1) of one block; returns them and the position
    of the one that is still fractional, or -1. The sum of size * part does not change."""
    part = part.copy()
    draws = rng.random(len(part))
    held = 0 if len(part) else -1
    for j in range(1, len(part)):
        if held < 0:
            held = j
            continue
        i = held
        up = min(size[i] * (1 - part[i]), size[j] * part[j])
        down = min(size[i] * part[i], size[j] * (1 - part[j]))
        move = up if draws[j] * (up + down) < down else -down
        part[i] += move / size[i]
        part[j] -= move / size[j]
        for k in (i, j):
            if part[k] < 1e-9 or part[k] > 1 - 1e-9:
                part[k] = round(part[k])
        held = i if 0 < part[i] < 1 else j if 0 < part[j] < 1 else -1
    return part, held


def _round(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "row"], kind="stable")
        rng = np.random.default_rng([seed, *(int(k) & 0xFFFFFFFF for k in key), len(pdf)])
        part, held = pivot(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), rng)
        if last and held >= 0:
            part[held] = float(rng.random() < part[held])
        return pdf.assign(part=part)

    return run


def mix(docs: DataFrame, *, row_col: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 20, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(row, id, source, size, source_size, target, copies) for each row of docs.

    Size is the number of words of the whole text (null or empty: 0, never copied). copies is a whole number
    of at most `most` rounded up; the words of a source's copies add up to its target but for less than one document.
    row_col is unique and stable; it only breaks ties between rows of equal id. The same rows give the same
    copies. A null source is a source of its own; an empty table gives no rows."""
    sized = written(docs.select(F.col(row_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size")), "sizes")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights=weights, share=share, most=most), "targets")
    rows = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    want = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(want + 1e-12).cast("long")).withColumn("part", F.greatest(want - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
    rows = rows.withColumn("draw", F.xxhash64("id", F.lit(seed))).withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.ceil(F.col("n") / block)))
    rows = rows.select("row", "id", "source", "size", "source_size", "target", "source_rank", "whole", "part", "draw", "block")
    schema = rows.schema
    blocks = -(-(sources.agg(F.max("n")).first()[0] or 0) // block)
    loose = (F.col("part") > 0) & (F.col("part") < 1)
    done = [rows.where(~loose)]
    left, level = rows.where(loose), 0
    while True:
        last = blocks <= 1
        left = written(left.groupBy("source_rank", "block").applyInPandas(_round(seed + level, last), schema), f"mix-{level}")
        done.append(left.where(~loose))
        if last:
            break
        left, blocks, level = left.where(loose).withColumn("block", F.expr(f"block div {fan}")), -(-blocks // fan), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row", "id", "source", "size", "source_size", "target", (F.col("whole") + F.round("part").cast("long")).alias("copies"))


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it, all its columns kept, whatever their names. Rows of null or blank text
    have no words and are not taken; a null source is one of its own; repeated rows and ids are drawn each for itself; ties are
    broken by the rows' places; an empty table stays empty."""
    row, times = free(docs.columns, "_row"), free(docs.columns, "_copies")
    stamped = written(docs.withColumn(row, F.monotonically_increasing_id()), "stamped")
    copies = mix(stamped, row_col=row, **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    return stamped.join(copies, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*named(docs.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("_row", F.monotonically_increasing_id())
    found = mix(docs, row_col="_row")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
