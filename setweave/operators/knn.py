"""Exact k nearest sets under Jaccard similarity, by several plans that return the same rows.

A result row is (query_id, neighbor_id, overlap, similarity, rank), ranked by similarity and then by the smaller id; the
query itself counts, pairs without a common token do not. Every plan finds candidate pairs by equal tokens, signatures or
groups (never by comparing all with all), and prunes by thresholds that are exact fractions, so ties survive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.functions import bounds as B
from setweave.functions.grouping import group_bounds, with_group
from setweave.operators import elements as E
from setweave.operators import tiles
from setweave.sources.shared import swept, written

#: Share of all common-token rows above which a pruned join is not worth its verification: the rows are counted outright.
COUNT_FROM = 0.25
#: Queries, about, whose thresholds tell whether those of all are worth finding.
PROBED = 2000

RESULT = ["query_id", "neighbor_id", "overlap", "similarity", "rank"]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query of (q, c, overlap, n_q, n_c)."""
    sim = B.jaccard("overlap", "n_q", "n_c")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "c"))
    return scored.withColumn("similarity", sim).withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("c").alias("neighbor_id"), F.col("overlap").cast("int").alias("overlap"), "similarity", F.col("rank").cast("int").alias("rank"))


def sides(elems: DataFrame, queries: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The elements as the query's side (q, token, pos_q, n_q), of some queries only, and as the other (c, token, pos_c, n_c)."""
    q = elems if queries is None else elems.join(queries.select("id").distinct(), "id", "left_semi")
    names = lambda d, s: d.select(F.col("id").alias("q" if s == "q" else "c"), "token", F.col("pos").alias(f"pos_{s}"), F.col("n").alias(f"n_{s}"))
    return names(q, "q"), names(elems, "c")


def count_overlaps(pairs: DataFrame) -> DataFrame:
    """(q, c, overlap, n_q, n_c) of one row for each common token. The rows are dealt by query once; counting and ranking
    both stay in that layout, so a query's pairs are shuffled a single time."""
    dealt = pairs.select("q", "c", "n_q", "n_c").repartition("q")
    return dealt.groupBy("q", "c").agg(F.count("*").alias("overlap"), F.first("n_q").alias("n_q"), F.first("n_c").alias("n_c"))


def token_join(elems: DataFrame, k: int, queries: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """Counts the common tokens of all pairs that have one, in tiles; (id, token) is all that elems needs. With others, these are the candidates instead of elems,
    and pairs are counted by a join."""
    if others is None:
        return top_k(tiles.nearest(elems, k, queries), k)
    return top_k(count_overlaps(sides(elems, queries)[0].join(sides(others, None)[1], "token")), k)


def verify(candidates: DataFrame, sets: DataFrame, query_sets: DataFrame | None = None) -> DataFrame:
    """(q, c, overlap, n_q, n_c) of distinct candidate pairs, from the sets themselves."""
    a = (sets if query_sets is None else query_sets).select(F.col("id").alias("q"), F.col("tokens").alias("t_q"), F.col("n").alias("n_q"))
    b = sets.select(F.col("id").alias("c"), F.col("tokens").alias("t_c"), F.col("n").alias("n_c"))
    got = candidates.select("q", "c").distinct().join(b, "c").join(a, "q")
    return got.select("q", "c", F.size(F.array_intersect("t_q", "t_c")).cast("long").alias("overlap"), "n_q", "n_c").where("overlap > 0")


def thresholds(scored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, n_q, o_t, u_t): each query's k-th best similarity among the scored pairs, as a fraction; 0 / 1 if it has fewer."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(B.jaccard("overlap", "n_q", "n_c")), "c"))
    at = scored.withColumn("rank", rank).where(F.col("rank") == k).select("q", F.col("overlap").alias("o_t"), (F.col("n_q") + F.col("n_c") - F.col("overlap")).alias("u_t"))
    return queries.join(at, "q", "left").select("q", "n_q", F.coalesce("o_t", F.lit(0)).cast("long").alias("o_t"), F.coalesce("u_t", F.lit(1)).cast("long").alias("u_t"))


def rare_token_seeds(elems: DataFrame, queries: DataFrame | None, first: int = 2, most: int = 32) -> DataFrame:
    """Candidate pairs that share one of the query's `first` rarest tokens that other sets have too and at most `most` sets."""
    shared = elems.where(F.col("freq").between(2, most)).select("id", "token", "pos", "n")
    q, c = sides(shared, queries)
    rare = q.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("pos_q"))).where(F.col("r") <= first)
    own = sides(elems, queries)[0].select("q", F.col("q").alias("c")).distinct()
    return rare.join(c, "token").select("q", "c").unionByName(own).distinct()


def pruned_join(elems: DataFrame, at: DataFrame, queries: DataFrame | None, *, length: bool = True, position: bool = True, bounds: DataFrame | None = None, accept: Column | None = None) -> DataFrame:
    """Distinct candidate pairs whose first common token is early enough for the query's threshold.

    The query's side loses its common tokens before the join: past position n_q - prefix_overlap none can be the first of a
    good pair. length and position add the bounds on the other set's size and position. With group bounds, only groups of
    sizes that can reach the threshold are probed and the group is part of the join key. accept is a further condition over
    q, c and their n."""
    q, c = sides(elems, queries)
    low, high = B.size_window("n_q", "o_t", "u_t")
    on = ["token"]
    if bounds is not None:
        c = with_group(c, bounds, "n_c")
        reached = at.join(F.broadcast(bounds.select("grp", "lo", "hi")), (F.col("hi") >= low) & (F.col("lo") <= high)).select("q", "grp")  # by query; a row of bounds for each size at most
        q = q.join(reached, "q")
        on = ["grp", "token"]
    q = q.join(at.drop("n_q"), "q").where(F.col("pos_q") <= F.col("n_q") - B.prefix_overlap("n_q", "o_t", "u_t"))
    got = q.join(c, on)
    if length:
        got = got.where(F.col("n_c").between(low, high))
    if position:
        need = B.required_overlap("n_q", "n_c", "o_t", "u_t")
        got = got.where((F.col("pos_q") <= F.col("n_q") - need) & (F.col("pos_c") <= F.col("n_c") - need))
    if accept is not None:
        got = got.where(accept)
    return got.select("q", "c", "n_q", "n_c", "o_t", "u_t").distinct()


def _start(elems: DataFrame, k: int, queries: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The elements and the sets, each computed once, and the queries' thresholds; none where those of about PROBED queries, by
    the hash of their ids, leave so many rows that pairs are counted: that chooses the plan, not a row of its result."""
    elems = written(elems, "elements")
    sets = written(E.sets(elems), "sets")
    swept(elems.sparkSession)
    asked = sets.select("id") if queries is None else sets.select("id").join(queries.select("id").distinct(), "id", "left_semi")

    def at(of: DataFrame) -> DataFrame:
        q = sides(elems, of)[0].select("q", "n_q").distinct()
        return written(thresholds(verify(rare_token_seeds(elems, of), sets), q, k), "thresholds")

    n = asked.count()
    if n >= 2 * PROBED:
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(n // PROBED)) == 0)
        if not few_remain(elems, at(some), some):
            return elems, sets, None
    return elems, sets, at(queries)


def few_remain(elems: DataFrame, at: DataFrame, queries: DataFrame | None) -> bool:
    """Whether the prefixes that the thresholds leave meet in less than COUNT_FROM of the rows of the whole token join."""
    q = elems if queries is None else elems.join(queries.select("id").distinct(), "id", "left_semi")
    kept = F.col("pos") <= F.col("n") - B.prefix_overlap("n", "o_t", "u_t")
    rows = q.join(at.select(F.col("q").alias("id"), "o_t", "u_t"), "id").agg(F.sum("freq"), F.sum(F.when(kept, F.col("freq")))).first()
    return (rows[1] or 0) < COUNT_FROM * (rows[0] or 0)


def scored_pairs(elems: DataFrame, sets: DataFrame, at: DataFrame | None, queries: DataFrame | None, k: int, more: Callable[[DataFrame], DataFrame] = lambda got: got, **how) -> DataFrame:
    """(q, c, overlap, n_q, n_c) of pairs, the k best of each query among them: where the thresholds prune, candidates of the
    pruned join that pass `more`, verified; where most rows would remain, by counting them in tiles."""
    if at is not None and few_remain(elems, at, queries):
        return verify(more(pruned_join(elems, at, queries, **how)), sets)
    return tiles.nearest(elems, k, queries)


def banded(elems: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Pairs within the size band of the query's threshold."""
    elems, sets, at = _start(elems, k, queries)
    return top_k(scored_pairs(elems, sets, at, queries, k, position=False), k)


def token_at_a_time(elems: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Pairs that meet in the query's prefix, with no bound on the other side."""
    elems, sets, at = _start(elems, k, queries)
    return top_k(scored_pairs(elems, sets, at, queries, k, length=False, position=False), k)


def grouping_of(elems: DataFrame, grouping: str) -> DataFrame:
    """The group bounds of a collection; the two balanced groupings take their number of groups from its statistics."""
    histogram = E.length_histogram(elems)
    groups = 1
    if grouping in ("wsqrt", "usqrt"):
        tokens, volume, universe = elems.groupBy("token").agg(F.count("*").alias("f")).agg(F.sum("f"), F.sum(F.col("f") * F.col("f")), F.count("*")).first()
        rule = B.weighted_group_count(F.lit(volume), F.lit(tokens)) if grouping == "wsqrt" else B.uniform_group_count(F.lit(tokens), F.lit(universe))
        groups = elems.sparkSession.range(1).select(rule).first()[0] if tokens else 1
    return group_bounds(histogram, grouping, groups)


def positional(elems: DataFrame, k: int, queries: DataFrame | None = None, *, grouping: str = "aio", full: bool = False, suffix_depth: int = 0, fingerprint: bool = False) -> DataFrame:
    """Prefix, size and position bounds, with the length group in the join key; `full` also lets no pair pass whose
    positions bound its similarity below the threshold. The two options test candidates further before they are verified; pairs
    that are counted outright need no test."""
    elems, sets, at = _start(elems, k, queries)
    # where both sides of a pair stand, the tokens that may still be common bound the overlap
    still = F.least(F.col("n_q") - F.col("pos_q"), F.col("n_c") - F.col("pos_c")) >= B.required_overlap("n_q", "n_c", "o_t", "u_t")
    how = {"bounds": grouping_of(elems, grouping), "accept": still if full else None}

    def more(got: DataFrame) -> DataFrame:
        got = hamming_filter(got, elems, 2**suffix_depth) if suffix_depth else got
        return fingerprint_filter(got, elems) if fingerprint else got

    return top_k(scored_pairs(elems, sets, at, queries, k, more, **how), k)


def counters(elems: DataFrame, buckets: int, by: Column, name: str) -> DataFrame:
    """(id, name): how many of a set's tokens fall into each of the buckets."""
    cells = elems.groupBy("id", by.alias("b")).agg(F.count("*").alias("x"))
    held = F.map_from_entries(F.collect_list(F.struct("b", "x")))
    return cells.groupBy("id").agg(held.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b.cast("int")), F.lit(0).cast("long"))).alias(name))


def hamming_filter(pairs: DataFrame, elems: DataFrame, buckets: int) -> DataFrame:
    """Pairs whose token counts by bucket do not differ by more than the threshold allows."""
    f = counters(elems, buckets, F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"), "f")
    got = pairs.join(f.withColumnsRenamed({"id": "q", "f": "f_q"}), "q").join(f.withColumnsRenamed({"id": "c", "f": "f_c"}), "c")
    apart = F.aggregate(F.zip_with("f_q", "f_c", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.where(apart <= F.col("n_q") + F.col("n_c") - 2 * B.required_overlap("n_q", "n_c", "o_t", "u_t")).drop("f_q", "f_c")


def dual_groups(freq: DataFrame, groups: int = 16) -> DataFrame:
    """(token, freq, f, g): two groupings of the tokens into as many groups, of balanced loads. From the most frequent token on
    they are dealt to and fro over the groups of the first; each round of it goes to one group of the second, the rounds to and
    fro as well, so tokens that share a group of one are spread over the other."""
    ranked = E.numbered(freq.withColumn("less", -F.col("freq")), "r", "less", "token").drop("less")
    fro = lambda at: F.when(F.floor(at / groups) % 2 == 0, at % groups).otherwise(groups - 1 - at % groups).cast("int")
    return ranked.select("token", "freq", fro(F.col("r")).alias("f"), fro(F.floor(F.col("r") / groups)).alias("g"))


def dual_fingerprints(elems: DataFrame, groups: int = 16) -> DataFrame:
    """(id, f, g): token counts of two groupings of the tokens (dual_groups); any grouping gives valid bounds."""
    of = dual_groups(elems.select("token", "freq").distinct(), groups).drop("freq")
    rows = elems.select("id", "token").join(of, "token")
    return counters(rows, groups, F.col("f"), "x").withColumnRenamed("x", "f").join(counters(rows, groups, F.col("g"), "x").withColumnRenamed("x", "g"), "id")


def fingerprint_filter(pairs: DataFrame, elems: DataFrame) -> DataFrame:
    """Pairs whose fingerprints allow the overlap that the threshold requires."""
    f = written(dual_fingerprints(elems), "fingerprints")
    got = pairs.join(f.withColumnsRenamed({"id": "q", "f": "f_q", "g": "g_q"}), "q").join(f.withColumnsRenamed({"id": "c", "f": "f_c", "g": "g_c"}), "c")
    most = F.least(B.fingerprint_overlap("f_q", "f_c"), B.fingerprint_overlap("g_q", "g_c"))
    return got.where(most >= B.required_overlap("n_q", "n_c", "o_t", "u_t")).drop("f_q", "f_c", "g_q", "g_c")


def signatures(ranked: DataFrame) -> DataFrame:
    """(id, cls, sig, size) for each class in which a set has tokens, of (id, token) with whole-number tokens. The class of a
    token is its number of trailing zero bits; token 0, which has none, is a class of its own. sig is the class's tokens."""
    cls = F.coalesce(B.token_class("token"), F.lit(-1))
    return ranked.groupBy("id", cls.alias("cls")).agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("sig"), F.count("*").alias("size"))


def deletions(ranked: DataFrame) -> DataFrame:
    """(id, cls, sig): each class's tokens with one of them left out."""
    cls = F.coalesce(B.token_class("token"), F.lit(-1))
    held = ranked.groupBy("id", cls.alias("cls")).agg(F.array_sort(F.collect_list("token")).alias("t"))
    return held.select("id", "cls", F.explode(F.transform("t", lambda x: F.array_join(F.array_remove("t", x), ","))).alias("sig"))


def signature_join(elems: DataFrame, k: int, queries: DataFrame | None = None, *, deletion: bool = False) -> DataFrame:
    """Pairs that agree in a whole token class, or with deletion in all but one token of it.

    A pair that agrees in no class differs in each class that the query has, by one token at least (with deletion by two,
    if the query has two there),
    which bounds its similarity. Queries whose k-th match so far is not above that bound are finished by the pruned token
    join at the threshold they have, so no match is lost whatever the universe."""
    elems = written(elems, "elements")
    sets = written(E.sets(elems), "sets")
    own = signatures(elems.select("id", "token"))
    q = own if queries is None else own.join(queries.select("id").distinct(), "id", "left_semi")
    rename = lambda d, to: d.select(F.col("id").alias(to), "cls", "sig")
    pairs = rename(q, "q").join(rename(own, "c"), ["cls", "sig"])
    if deletion:
        less = deletions(elems.select("id", "token")).where("sig != ''")
        less_q = less if queries is None else less.join(queries.select("id").distinct(), "id", "left_semi")
        pairs = pairs.unionByName(rename(q, "q").join(rename(less, "c"), ["cls", "sig"])).unionByName(rename(less_q, "q").join(rename(own, "c"), ["cls", "sig"]))
    scored = written(verify(pairs.select("q", "c").distinct(), sets), "scored")
    sizes = q.groupBy(F.col("id").alias("q")).agg(F.sum("size").cast("int").alias("n_q"), F.sum(F.least("size", F.lit(2)) if deletion else F.lit(1)).alias("d"))
    at = thresholds(scored, sizes.select("q", "n_q"), k).join(sizes.select("q", "d"), "q")
    # n / (n + d) >= o / u, in whole numbers
    open_ = written(at.where(F.col("n_q") * F.col("u_t") >= F.col("o_t") * (F.col("n_q") + F.col("d"))).drop("d"), "open")
    rest = scored_pairs(elems, sets, open_, open_.select(F.col("q").alias("id")), k)
    done = scored.join(open_.select("q"), "q", "left_anti")  # an open query's rest holds all that its threshold lets pass
    return top_k(done.unionByName(rest), k)


def box_join(elems: DataFrame, k: int, queries: DataFrame | None = None, boxes: int = 64) -> DataFrame:
    """Dual fingerprints as points: buckets of like points, `boxes` at most, have a box around their points of a tile. There the
    best box of a query gives its threshold, and only those are opened whose bound reaches it; their points are counted."""
    elems = written(elems.select("id", "token", "freq"), "elements")
    labelled = written(elems.join(dual_groups(elems.select("token", "freq").distinct()).drop("freq"), "token").select("id", "token", "f", "g"), "labelled")
    swept(elems.sparkSession)
    points = labelled.groupBy("id").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("f") == i) for i in range(16)]).alias("f"))
    busiest = F.array_position("f", F.array_max("f")).cast("int")
    buckets = points.select("id", (F.least(F.floor(F.log2("n")), F.lit(boxes // 16 - 1)) * 16 + busiest - 1).cast("int").alias("bucket"))
    return top_k(tiles.nearest_by_boxes(labelled, k, buckets, queries), k)


def group_tokens(elems: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, token): the union of each group's sets. groups is (group_id, id)."""
    return elems.select("id", "token").join(groups, "id").select("group_id", "token").distinct()


def group_order(elems: DataFrame, groups: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(q, n_q, group_id, hits, bound, place): groups that share a token with a query, by the share of the query's tokens
    that they have; ties by the larger group."""
    q = sides(elems, queries)[0].select("q", "token", "n_q")
    hits = q.join(group_tokens(elems, groups), "token").groupBy("q", "group_id").agg(F.count("*").alias("hits"), F.first("n_q").alias("n_q"))
    out = hits.withColumn("bound", F.col("hits") / F.col("n_q"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), F.desc("group_id"))))


def grouped(elems: DataFrame, k: int, groups: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """In each tile, the best group of a query gives its threshold; then the groups are searched whose bound reaches it.
    (id, token) is all that elems needs."""
    return top_k(tiles.nearest(elems, k, queries, written(groups, "groups")), k)


def minhash_signature(pairs: DataFrame, hashes: int = 8) -> DataFrame:
    """(id, h, value): for each hash function the least digest of a set's tokens."""
    h = F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("h")
    return pairs.select("id", "token", h).groupBy("id", "h").agg(F.min(F.md5(F.concat_ws(":", F.col("h").cast("string"), F.col("token").cast("string")).cast("binary"))).alias("value"))


def minhash_candidates(pairs: DataFrame, hashes: int = 8, rows: int = 1) -> DataFrame:
    """Distinct (q, c) that agree in all the values of a band of `rows` hash functions."""
    sig = minhash_signature(pairs, hashes).groupBy("id", F.floor(F.col("h") / rows).alias("band")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("h").cast("string"), "value"))), "|").alias("key"))
    a, b = sig.withColumnRenamed("id", "q"), sig.withColumnRenamed("id", "c")
    return a.join(b, ["band", "key"]).select("q", "c").distinct()


def minhash_join(elems: DataFrame, k: int, hashes: int = 8, rows: int = 1, queries: DataFrame | None = None) -> DataFrame:
    """The k best of the banded candidates by exact similarity; matches that share no band are missed."""
    got = minhash_candidates(elems.select("id", "token"), hashes, rows)
    if queries is not None:
        got = got.join(queries.select(F.col("id").alias("q")).distinct(), "q", "left_semi")
    return top_k(verify(got, E.sets(elems)), k)


def recalled_join(elems: DataFrame, k: int, least: float, hashes: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """The k best, each true one found with probability `least` or more. A set at similarity s shares one of the hashes with
    probability 1 - (1 - s)^hashes, and the k-th similarity found is at most the true one: queries for which that is too low,
    or that have fewer than k matches, are finished exactly."""
    elems = elems if "_written" in vars(elems) else written(elems.select("id", "token"), "elements")
    found = written(top_k(tiles.nearest_in_bands(elems, k, hashes, queries=queries), k), "min-hash")
    sure = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("low")).where((F.col("n") >= k) & (1 - F.pow(1 - F.col("low"), F.lit(hashes)) >= least))
    sure = sure.select(F.col("query_id").alias("id"))
    asked = elems.select("id").distinct() if queries is None else queries.select("id").distinct()
    rest = token_join(elems, k, asked.join(sure, "id", "left_anti"))
    return found.join(sure.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(rest)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (matches, found, recall): how many exact result rows the other result has at the same or better similarity."""
    kth = exact.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count("*").alias("need"))
    good = found.join(kth, "query_id").where(F.col("similarity") >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("got"))
    both = kth.join(good, "query_id", "left")
    return both.agg(F.sum("need").alias("matches"), F.sum(F.least(F.coalesce("got", F.lit(0)), "need")).alias("found")).withColumn("recall", F.col("found") / F.col("matches"))


def kth_similarity(result: DataFrame, k: int) -> DataFrame:
    """(query_id, matches, kth): the k-th similarity of each query, 0 if it has fewer matches."""
    return result.groupBy("query_id").agg(F.count("*").alias("matches"), F.min("similarity").alias("low")).select("query_id", "matches", F.when(F.col("matches") < k, 0.0).otherwise(F.col("low")).alias("kth"))


def search(elems: DataFrame, config, queries: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """The plan that a KnnConfig names. Unknown names are refused by the configuration itself."""
    if config.mode == "sample" and queries is None:
        queries = E.draw_queries(elems.select("id").distinct(), config.sample_size, config.seed).select("id").distinct()
    options = {"suffix_depth": config.suffix_depth, "fingerprint": config.fingerprint}
    plans = {
        "baseline": lambda: token_join(elems, config.k, queries),
        "baselinepp": lambda: banded(elems, config.k, queries),
        "topkbaseline": lambda: token_at_a_time(elems, config.k, queries),
        "slim": lambda: positional(elems, config.k, queries, grouping=config.grouping, **options),
        "full": lambda: positional(elems, config.k, queries, grouping=config.grouping, full=True, **options),
        "eager": lambda: positional(elems, config.k, queries, grouping="identity", **options),
        "grouping": lambda: positional(elems, config.k, queries, grouping="wsqrt", full=True, **options),
        "partition": lambda: signature_join(elems, config.k, queries, deletion=config.deletion),
        "palloc": lambda: signature_join(elems, config.k, queries, deletion=True),
        "transformation": lambda: box_join(elems, config.k, queries),
        "les3": lambda: grouped(elems, config.k, groups, queries),
        "puffinn": lambda: recalled_join(elems, config.k, config.recall, queries=queries),
    }
    return plans[config.algorithm]()
