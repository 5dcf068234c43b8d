"""Similarities and bounds of sets as column expressions.

r, s and n are set sizes, o an overlap, p a position in a set whose tokens are in rarest-first order. A threshold is the
pair (o_t, u_t) of overlap and union whose quotient it is: required overlaps then need integer arithmetic only, and sets
exactly at the threshold are never lost to rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x


def ceil_div(a: Column, b: Column) -> Column:
    """The quotient of non-negative whole numbers, rounded up."""
    up = a + b - 1
    return ((up - F.pmod(up, b)) / b).cast("long")


def jaccard(o, r, s) -> Column:
    """Overlap over union."""
    o, r, s = col(o), col(r), col(s)
    return o / (r + s - o)


def dice_distance(o, r, s) -> Column:
    """1 - 2 o / (r + s); two empty sets are at distance 0."""
    o, r, s = col(o), col(r), col(s)
    return F.when(r + s == 0, F.lit(0.0)).otherwise(1 - 2 * o / (r + s))


def symmetric_difference(o, r, s) -> Column:
    """How many tokens are in one of two sets only."""
    return col(r) + col(s) - 2 * col(o)


def similarity_bound(r, s, p_r, p_s) -> Column:
    """The most similar that sets can be whose first common token stands at p_r and p_s."""
    r, s = col(r), col(s)
    m = F.least(r - col(p_r), s - col(p_s))
    return m / (r + s - m)


def group_bound(r, p_r, lo) -> Column:
    """similarity_bound to the best size of a group of sizes from lo on, positions aligned."""
    r, p_r, lo = col(r), col(p_r), col(lo)
    s = F.greatest(lo, r - p_r)
    m = F.least(r - p_r, s)
    return m / (r + s - m)


def required_overlap(r, s, o_t, u_t) -> Column:
    """The least overlap with which sets of r and s tokens reach the threshold; 1 at least."""
    return F.greatest(F.lit(1).cast("long"), ceil_div(col(o_t) * (col(r) + col(s)), col(u_t) + col(o_t)))


def prefix_overlap(r, o_t, u_t) -> Column:
    """The least overlap with which a set of r tokens reaches the threshold with any other."""
    return F.greatest(F.lit(1).cast("long"), ceil_div(col(o_t) * col(r), col(u_t)))


def last_position(r, s, o_t, u_t) -> Column:
    """The last position in a set of s tokens at which the first common token may stand."""
    return col(s) - required_overlap(r, s, o_t, u_t)


def size_window(n, o_t, u_t) -> tuple[Column, Column]:
    """Smallest and largest size of a set that reaches the threshold; without a threshold, any."""
    n, o, u = col(n), col(o_t), col(u_t)
    return ceil_div(o * n, u), F.when(o > 0, F.floor(n * u / F.greatest(o, F.lit(1)))).otherwise(F.lit(2**62)).cast("long")


def hamming_bound(q, d) -> Column:
    """The most similar that any set can be to one of q tokens from which it differs in d."""
    q, d = col(q), col(d)
    return q / (q + d)


def two_sided_bound(q, s, d) -> Column:
    q, s, d = col(q), col(s), col(d)
    return (q + s - d) / (q + s + d)


def fingerprint_overlap(f, g) -> Column:
    """No overlap exceeds the sum of the lesser counters of two fingerprints."""
    return F.aggregate(F.zip_with(f, g, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)


def point_distance(m, p, q) -> Column:
    """1 - m / (p + q - m) of fingerprints with p and q tokens and m common ones at most."""
    m, p, q = col(m), col(p), col(q)
    return 1 - m / (p + q - m)


def box_similarity(f, low, high) -> Column:
    """An upper bound of the similarity of a point to any in a box: summed minima with its top over summed maxima with its bottom."""
    top = F.aggregate(F.zip_with(f, high, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
    bottom = F.aggregate(F.zip_with(f, low, lambda x, y: F.greatest(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(bottom == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top / bottom))


def token_class(t) -> Column:
    """The number of trailing zero bits of a positive whole number; 0 has no class (null)."""
    t = col(t).cast("long")
    return F.when(t != 0, F.bit_count((t.bitwiseAND(-t)) - 1))


def class_count(universe) -> Column:
    """How many classes the tokens below the universe have."""
    return (F.ceil(F.log2(col(universe).cast("double"))) + 1).cast("int")


def set_hash(tokens) -> Column:
    """A hash of a set that a token enters and leaves by exclusive or."""
    return F.aggregate(col(tokens), F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.xxhash64(t)))


def uniform_group_count(tokens, universe) -> Column:
    """max(1, round(sqrt(tokens / (2 universe))))."""
    return F.greatest(F.lit(1), F.round(F.sqrt(col(tokens) / (2 * col(universe)))).cast("int"))


def weighted_group_count(pairs, tokens) -> Column:
    """max(1, round(sqrt(pairs / (32 tokens)))), pairs being the sum of squared token frequencies."""
    return F.greatest(F.lit(1), F.round(F.sqrt(col(pairs) / (32 * col(tokens)))).cast("int"))


def path_dimensions(universe: int) -> int:
    """Dimensions of path counters over a universe."""
    return 2 * max(0, (universe - 1).bit_length()) if universe > 1 else 0


def path_bit(token, universe, level) -> Column:
    """Which half of its range a token falls into at a level of halving the universe."""
    return F.pmod(F.floor(col(token) / (col(universe) / 2 / F.pow(F.lit(2.0), col(level)))), F.lit(2)).cast("int")


def split_targets(records: int, initial: int, share: float = 0.005) -> tuple[int, int]:
    """Target number of groups, and levels of halving that lead to it from the initial groups."""
    from math import ceil, log2

    target = max(1, ceil(share * records))
    return target, max(0, ceil(log2(target / max(1, initial)))) if target > initial else 0


def mebibytes(n) -> Column:
    return col(n) / 1048576


def file_stem(path) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_replace(col(path), r"^.*/", ""), r"\.[^.]*$", "")


def snippet(text, limit: int | Column = 4000) -> Column:
    """The first characters of a text."""
    return F.substring(col(text), F.lit(1), col(limit))


def memory_estimate(file_bytes, tokens=None, limit=None) -> Column:
    """Bytes that a run is expected to hold: three times its file, or 54 for each token within a limit, and a tenth more."""
    return 3 * col(file_bytes) if tokens is None else F.least(54 * col(tokens), col(limit)) * 1.1
