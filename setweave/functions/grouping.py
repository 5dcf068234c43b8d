"""Length groups: contiguous ranges of set sizes.

The histogram of sizes has one row for each distinct size, so it is small whatever the collection's size; a balanced split
is solved on it on the driver and comes back as a table of group bounds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDS = "grp int, lo long, hi long, sets long, weight long"


def balanced(histogram: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Splits (size, weight) rows, in order of size, into at most so many runs whose largest weight is least."""
    if not histogram:
        return []

    def runs(limit: int) -> list[list[tuple[int, int]]]:
        out, total = [[]], 0
        for row in histogram:
            if out[-1] and total + row[1] > limit:
                out.append([])
                total = 0
            out[-1].append(row)
            total += row[1]
        return out

    lo, hi = max(w for _, w in histogram), sum(w for _, w in histogram)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if len(runs(mid)) <= groups else (mid + 1, hi)
    return runs(lo)


def group_bounds(histogram: DataFrame, grouping: str = "identity", groups: int = 1, width: int = 3) -> DataFrame:
    """(grp, lo, hi, sets, weight) from a histogram (n, sets, weight): bounds are inclusive and groups numbered in order.

    identity: a group for each size; aio: one for all, from 1; fixed: ranges of `width` from the smallest size, empty ones
    left out; wsqrt and usqrt: `groups` balanced ones."""
    rows = [tuple(r) for r in histogram.select("n", "sets", "weight").orderBy("n").collect()]
    if grouping == "identity":
        ranges = [(n, n) for n, _, _ in rows]
    elif grouping == "aio":
        ranges = [(1, rows[-1][0])] if rows else []
    elif grouping == "fixed":
        first = rows[0][0] if rows else 0
        ranges = [(first + k * width, first + k * width + width - 1) for k in sorted({(n - first) // width for n, _, _ in rows})]
    elif grouping in ("wsqrt", "usqrt"):
        ranges = [(g[0][0], g[-1][0]) for g in balanced([(n, w) for n, _, w in rows], groups)]
    else:
        raise ValueError(f"unknown length grouping {grouping!r}")
    sizes = [n for n, _, _ in rows]
    summed = list(accumulate((s for _, s, _ in rows), initial=0)), list(accumulate((w for _, _, w in rows), initial=0))
    out = []
    for k, (lo, hi) in enumerate(ranges):
        i, j = bisect_left(sizes, lo), bisect_right(sizes, hi)
        out.append((k, lo, hi, *[t[j] - t[i] for t in summed]))
    return histogram.sparkSession.createDataFrame(out, BOUNDS)


def with_group(rows: DataFrame, bounds: DataFrame, n: str = "n") -> DataFrame:
    """rows with the group of their size. Each size that occurs is given its group once, and joined by equality; there are as
    many rows of these as distinct sizes."""
    sizes = rows.select(F.col(n).alias("_n")).distinct()
    of = sizes.join(F.broadcast(bounds.select("grp", "lo", "hi")), F.col("_n").between(F.col("lo"), F.col("hi"))).select("_n", "grp")
    return rows.join(F.broadcast(of), F.col(n) == F.col("_n")).drop("_n")
