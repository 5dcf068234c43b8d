"""What the operators share: written intermediate tables, names of columns, slices of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.sources.shared import scratch, shared_folder, written

__all__ = ["free", "named", "scratch", "shared_folder", "slices", "stamped", "written"]

# What a batch held goes back to the system when it is done with; executors' memory is shared with the JVM.
pa.set_memory_pool(pa.system_memory_pool())

def stamped(df: DataFrame, row_col: str) -> DataFrame:
    """df as a written table with a column that numbers its rows; the numbers are unique, and stable because they are written."""
    return written(df.withColumn(row_col, F.monotonically_increasing_id()), "stamped")


def free(columns: list[str], name: str) -> str:
    """name, or name with as many underscores as it takes to be none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """The columns of these names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


#: Bytes of a slice of a batch.
SLICE_BYTES = 24 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows, fewer where rows are long, which bounds what a worker holds at a time."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
