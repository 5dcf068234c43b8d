"""Queries by name, and the SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions import bounds as B
from setweave.functions.grouping import group_bounds
from setweave.operators import elements as E
from setweave.operators import evaluation as V
from setweave.operators import knn as N
from setweave.operators import partitioning as P
from setweave.operators import statistics as S
from setweave.operators import tiles
from setweave.sources import files as IO
from setweave.sources.shared import scratch, written
from setweave.sources.tables import COLLECTIONS, table

#: Neighbours asked for: five and the set itself.
K = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PAIRS_SQL = {
    "customer_parts": "SELECT DISTINCT o_custkey AS id, l_partkey AS token FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "order_parts": "SELECT DISTINCT l_orderkey AS id, l_partkey AS token FROM lineitem",
    "supplier_parts": "SELECT DISTINCT l_suppkey AS id, l_partkey AS token FROM lineitem",
    "user_types": "SELECT DISTINCT user_id AS id, event_type || '|' || CAST(hour(ts) AS VARCHAR) AS token FROM events",
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def pairs_of(spark: SparkSession, sf_dir: str, collection: str) -> DataFrame:
    return COLLECTIONS[collection](spark, sf_dir)


def elements_of(spark: SparkSession, sf_dir: str, collection: str) -> DataFrame:
    return E.elements(pairs_of(spark, sf_dir, collection))


def with_elements(collection: str, select: str) -> str:
    """SQL with p (id, token), f (token, freq), r (token, freq, rank) and e (id, token, freq, pos, n) in scope."""
    return f"""WITH p AS ({PAIRS_SQL[collection]}), f AS (SELECT token, count(*) AS freq FROM p GROUP BY token),
r AS (SELECT token, freq, row_number() OVER (ORDER BY freq, token) - 1 AS rank FROM f),
e AS (SELECT p.id, p.token, freq, CAST(row_number() OVER (PARTITION BY p.id ORDER BY rank) - 1 AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY p.id) AS INTEGER) AS n FROM p JOIN r ON p.token = r.token),
h AS (SELECT n, count(*) AS sets, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT id, count(*) AS n FROM p GROUP BY id) GROUP BY n)
{select}"""


def knn_sql(collection: str, queries: str = "true", k: int = K, select: str = "SELECT query_id, neighbor_id, overlap, similarity, rank FROM best") -> str:
    """The k nearest by counting all common tokens."""
    return with_elements(collection, f""", o AS (SELECT a.id AS q, b.id AS c, count(*) AS overlap, any_value(a.n) AS nq, any_value(b.n) AS nc FROM e a JOIN e b ON a.token = b.token WHERE {queries} GROUP BY a.id, b.id),
s AS (SELECT q, c, overlap, CAST(overlap AS DOUBLE) / (nq + nc - overlap) AS similarity FROM o),
best AS (SELECT q AS query_id, c AS neighbor_id, CAST(overlap AS INTEGER) AS overlap, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) AS rank FROM s) WHERE rank <= {k})
{select}""")


# nearest sets: every plan has the same answer

for _c in PAIRS_SQL:
    query(f"knn_f1_{_c}", knn_sql(_c))(lambda s, d, c=_c: N.token_join(pairs_of(s, d, c), K))

_PLANS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "knn_baselinepp": lambda e: N.banded(e, K),
    "knn_topkbaseline": lambda e: N.token_at_a_time(e, K),
    **{f"knn_slim_{g}": (lambda e, g=g: N.positional(e, K, grouping=g)) for g in ("identity", "wsqrt", "usqrt", "aio", "fixed")},
    **{f"knn_full_{g}": (lambda e, g=g: N.positional(e, K, grouping=g, full=True)) for g in ("identity", "wsqrt")},
    "knn_suffix_filter": lambda e: N.positional(e, K, suffix_depth=4),
    "knn_fingerprint_filter": lambda e: N.positional(e, K, fingerprint=True),
    "knn_partition": lambda e: N.signature_join(e, K),
    "knn_palloc": lambda e: N.signature_join(e, K, deletion=True),
    "knn_transformation": lambda e: N.box_join(e, K),
}
for _n, _f in _PLANS.items():
    query(_n, knn_sql("customer_parts"))(lambda s, d, f=_f: f(E.elements(written(pairs_of(s, d, "customer_parts"), "pairs"))))


@query("knn_les3", knn_sql("customer_parts"))
def knn_les3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = written(pairs_of(spark, sf_dir, "customer_parts"), "pairs")
    return N.grouped(p, K, P.initial_groups(p))

_SAMPLED = "('0x' || substr(md5({id} || ':7'), 1, 8))::BIGINT % 100 < 20"


@query("knn_sample", knn_sql("customer_parts", _SAMPLED.format(id="CAST(a.id AS VARCHAR)")))
def knn_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements_of(spark, sf_dir, "customer_parts")
    return N.positional(e, K, E.hash_sample(e.select("id").distinct(), 20, seed=7))


@query("knn_rs", f"""WITH a0 AS ({PAIRS_SQL["order_parts"]}), b0 AS ({PAIRS_SQL["customer_parts"]}),
a AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM a0), b AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM b0),
o AS (SELECT a.id AS q, b.id AS c, count(*) AS overlap, any_value(a.n) AS nq, any_value(b.n) AS nc FROM a JOIN b ON a.token = b.token GROUP BY a.id, b.id),
s AS (SELECT q, c, overlap, CAST(overlap AS DOUBLE) / (nq + nc - overlap) AS similarity FROM o)
SELECT q AS query_id, c AS neighbor_id, CAST(overlap AS INTEGER) AS overlap, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) AS rank FROM s) WHERE rank <= {K}""")
def knn_rs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.token_join(elements_of(spark, sf_dir, "order_parts"), K, others=elements_of(spark, sf_dir, "customer_parts"))


@query("ksim_distribution", knn_sql("order_parts", select=f"SELECT kth, count(*) AS queries FROM (SELECT query_id, CASE WHEN count(*) < {K} THEN 0.0::DOUBLE ELSE min(similarity) END AS kth FROM best GROUP BY query_id) GROUP BY kth"))
def ksim_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.kth_similarity(N.token_join(elements_of(spark, sf_dir, "order_parts"), K), K).groupBy("kth").agg(F.count("*").alias("queries"))


@query("join_statistics", knn_sql("customer_parts", select=f"SELECT count(*) AS queries, CAST(sum(m) AS BIGINT) AS matches, round(avg(kth), 6) AS final_k_similarity, (SELECT count(*) FROM o) AS precandidates FROM (SELECT query_id, count(*) AS m, CASE WHEN count(*) < {K} THEN 0.0::DOUBLE ELSE min(similarity) END AS kth FROM best GROUP BY query_id)"))
def join_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements_of(spark, sf_dir, "customer_parts")
    q, c = N.sides(e, None)
    stats = S.join_statistics(N.token_join(e, K), q.join(c, "token").select("q", "c").distinct(), K)
    return stats.withColumn("final_k_similarity", F.round("final_k_similarity", 6))


# elements and statistics

query("token_frequency", with_elements("customer_parts", "SELECT token, freq FROM f"))(lambda s, d: E.token_frequency(pairs_of(s, d, "customer_parts")))
query("token_rank", with_elements("customer_parts", "SELECT token, freq, rank FROM r"))(lambda s, d: E.token_rank(pairs_of(s, d, "customer_parts")))
query("elements_pos", with_elements("customer_parts", "SELECT id, token, freq, pos, n FROM e"))(lambda s, d: elements_of(s, d, "customer_parts"))
query("relabelled", with_elements("order_parts", "SELECT p.id, rank AS token FROM p JOIN r ON p.token = r.token"))(lambda s, d: E.relabel(pairs_of(s, d, "order_parts")))
query("size_order", with_elements("order_parts", "SELECT id, n, row_number() OVER (ORDER BY n, id) - 1 AS number FROM (SELECT id, count(*) AS n FROM p GROUP BY id)"))(lambda s, d: E.renumber_by_size(pairs_of(s, d, "order_parts")))
query("universe_stats", with_elements("customer_parts", "SELECT (SELECT count(DISTINCT id) FROM p) AS sets, CAST(sum(freq) AS BIGINT) AS tokens, sum(freq)::DOUBLE / (SELECT count(DISTINCT id) FROM p) AS avg_size, count(*) AS universe, max(token) AS max_token, CAST(sum(freq * freq) AS BIGINT) AS pair_volume FROM f"))(lambda s, d: E.universe_stats(pairs_of(s, d, "customer_parts")))
query("length_histogram", with_elements("customer_parts", "SELECT n, sets, weight FROM h"))(lambda s, d: E.length_histogram(pairs_of(s, d, "customer_parts")))
query("existing_lengths", with_elements("order_parts", "SELECT n, sets FROM h WHERE n BETWEEN 3 AND 8"))(lambda s, d: E.length_histogram(pairs_of(s, d, "order_parts")).where(F.col("n").between(3, 8)).select("n", "sets"))
query("sampled_ids", with_elements("customer_parts", f"SELECT DISTINCT id FROM p WHERE {_SAMPLED.format(id='CAST(id AS VARCHAR)')}"))(lambda s, d: E.hash_sample(pairs_of(s, d, "customer_parts").select("id").distinct(), 20, seed=7))


@query("drawn_queries", "SELECT CAST(1000 AS BIGINT) AS draws, CAST(1000 AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS unknown, TRUE AS repeats")
def drawn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pairs_of(spark, sf_dir, "customer_parts").select("id").distinct()
    drawn = E.draw_queries(ids, 1000, 0x42424242).join(ids.withColumn("known", F.lit(1)), "id", "left")
    return drawn.agg(F.count("*").alias("draws"), F.count_distinct("draw").alias("numbers"), F.count_if(F.col("known").isNull()).alias("unknown"), (F.count_distinct("id") < 1000).alias("repeats"))


query("set_arrays", with_elements("order_parts", "SELECT id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(token AS VARCHAR), ',' ORDER BY token) AS tokens FROM p GROUP BY id"))(lambda s, d: E.sets(pairs_of(s, d, "order_parts")).select("id", "n", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens")))

_IDENTITY = "row_number() OVER (ORDER BY n) - 1"
query("group_bounds_identity", with_elements("customer_parts", f"SELECT CAST({_IDENTITY} AS INTEGER) AS grp, n AS lo, n AS hi, sets, weight FROM h"))(lambda s, d: group_bounds(E.length_histogram(pairs_of(s, d, "customer_parts")), "identity"))
query("group_bounds_aio", with_elements("customer_parts", "SELECT 0 AS grp, CAST(1 AS BIGINT) AS lo, max(n) AS hi, CAST(sum(sets) AS BIGINT) AS sets, CAST(sum(weight) AS BIGINT) AS weight FROM h"))(lambda s, d: group_bounds(E.length_histogram(pairs_of(s, d, "customer_parts")), "aio"))
query("group_bounds_fixed", with_elements("customer_parts", "SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS INTEGER) AS grp, lo, lo + 2 AS hi, sets, weight FROM (SELECT m + (n - m) // 3 * 3 AS lo, CAST(sum(sets) AS BIGINT) AS sets, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT *, min(n) OVER () AS m FROM h) GROUP BY 1)"))(lambda s, d: group_bounds(E.length_histogram(pairs_of(s, d, "customer_parts")), "fixed"))
#: The least limit with which filling runs one after the other needs no more than so many, and the runs that it gives.
_BALANCED = """, c AS (SELECT {count} AS groups FROM f), hh AS (SELECT *, row_number() OVER (ORDER BY n) AS i, sum(weight) OVER (ORDER BY n) AS upto FROM h),
lim AS (SELECT DISTINCT CAST(b.upto - a.upto + a.weight AS BIGINT) AS lim FROM hh a JOIN hh b ON a.i <= b.i WHERE b.upto - a.upto + a.weight >= (SELECT max(weight) FROM h)),
walk(lim, i, total, grp) AS (SELECT lim, CAST(1 AS BIGINT), CAST(weight AS BIGINT), 0 FROM lim, hh WHERE i = 1 UNION ALL SELECT lim, hh.i, CASE WHEN total + weight > lim THEN weight ELSE total + weight END, CASE WHEN total + weight > lim THEN grp + 1 ELSE grp END FROM walk JOIN hh ON hh.i = walk.i + 1)
SELECT grp, min(n) AS lo, max(n) AS hi, CAST(sum(sets) AS BIGINT) AS sets, CAST(sum(weight) AS BIGINT) AS weight FROM walk JOIN hh ON hh.i = walk.i
WHERE lim = (SELECT min(lim) FROM walk WHERE i = (SELECT max(i) FROM hh) AND grp + 1 <= (SELECT groups FROM c)) GROUP BY grp"""
for _g, _count in (("wsqrt", "greatest(1, CAST(round(sqrt(sum(freq * freq) / (32.0 * sum(freq)))) AS INTEGER))"), ("usqrt", "greatest(1, CAST(round(sqrt(sum(freq) / (2.0 * count(*)))) AS INTEGER))")):
    query(f"group_bounds_{_g}", with_elements("customer_parts", _BALANCED.format(count=_count)).replace("WITH p", "WITH RECURSIVE p", 1))(lambda s, d, g=_g: N.grouping_of(pairs_of(s, d, "customer_parts"), g))
query("size_index", with_elements("order_parts", "SELECT n, min(number) AS first, count(*) AS sets FROM (SELECT n, row_number() OVER (ORDER BY n, id) - 1 AS number FROM (SELECT id, count(*) AS n FROM p GROUP BY id)) GROUP BY n"))(lambda s, d: E.size_index(E.renumber_by_size(pairs_of(s, d, "order_parts"))))
query("group_histogram", with_elements("customer_parts", 'SELECT n AS size, sets AS count, weight, CAST(dense_rank() OVER (ORDER BY (n - m) // 3) - 1 AS INTEGER) AS "group" FROM (SELECT *, min(n) OVER () AS m FROM h)'))(lambda s, d: (lambda h: S.group_histogram(h, group_bounds(h, "fixed")))(E.length_histogram(pairs_of(s, d, "customer_parts"))))
query("list_size_stats", with_elements("customer_parts", "SELECT CAST(sum(x) AS BIGINT) AS sum, count(*) AS count, min(x) AS min, max(x) AS max, avg(x) AS avg FROM (SELECT n, token, count(*) AS x FROM e GROUP BY n, token)"))(lambda s, d: S.list_sizes(elements_of(s, d, "customer_parts"), group_bounds(E.length_histogram(pairs_of(s, d, "customer_parts")), "identity")))
query("event_bounds", with_elements("order_parts", f""", g AS (SELECT CAST({_IDENTITY} AS INTEGER) AS grp, n AS lo, n AS hi FROM h), q AS (SELECT n AS nq, unnest(range(0, n)) AS pos FROM h),
x AS (SELECT nq, grp, pos, CASE WHEN hi >= nq - pos THEN greatest(lo, nq - pos) ELSE hi END AS s, CASE WHEN hi >= nq - pos THEN least(nq - pos, greatest(lo, nq - pos)) ELSE least(nq - pos, hi) END AS m FROM q CROSS JOIN g)
SELECT nq AS n_q, grp, pos, CAST(m AS DOUBLE) / (nq + s - m) AS bound FROM x"""))(lambda s, d: S.event_bounds(E.length_histogram(pairs_of(s, d, "order_parts")).select("n"), group_bounds(E.length_histogram(pairs_of(s, d, "order_parts")), "identity")))


# bounds on a grid of sizes, positions and thresholds

_GRID = "WITH g AS (SELECT CAST(r.range AS BIGINT) AS r, CAST(s.range AS BIGINT) AS s, CAST(o.range AS BIGINT) AS o, CAST(u.range AS BIGINT) AS u FROM range(1, 16) r, range(1, 16) s, range(0, 6) o, range(1, 9) u WHERE o.range <= u.range)"


def grid(spark: SparkSession) -> DataFrame:
    seq = lambda a, b, n: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))).alias(n)
    out = spark.range(1).select(seq(1, 15, "r"))
    for a, b, n in ((1, 15, "s"), (0, 5, "o"), (1, 8, "u")):
        out = out.select("*", seq(a, b, n))
    return out.where("o <= u")


@query("bounds_grid", _GRID + """ SELECT r, s, o, u, greatest(1, (o * (r + s) + u + o - 1) // (u + o)) AS required, greatest(1, (o * r + u - 1) // u) AS prefix, s - greatest(1, (o * (r + s) + u + o - 1) // (u + o)) AS last_position,
(o * r + u - 1) // u AS size_low, CASE WHEN o > 0 THEN r * u // o ELSE 4611686018427387904 END AS size_high, CAST(r AS DOUBLE) / (r + o) AS hamming, CAST(r + s - o AS DOUBLE) / (r + s + o) AS two_sided,
CASE WHEN o < least(r, s) THEN CAST(least(r - o, s - o) AS DOUBLE) / (r + s - least(r - o, s - o)) END AS positional, 1 - 2.0 * least(o, least(r, s)) / CAST(r + s AS DOUBLE) AS dice FROM g""")
def bounds_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = B.size_window("r", "o", "u")
    return grid(spark).select(
        "r", "s", "o", "u", B.required_overlap("r", "s", "o", "u").alias("required"), B.prefix_overlap("r", "o", "u").alias("prefix"), B.last_position("r", "s", "o", "u").alias("last_position"), low.alias("size_low"), high.alias("size_high"),
        B.hamming_bound("r", "o").alias("hamming"), B.two_sided_bound("r", "s", "o").alias("two_sided"), F.when(F.col("o") < F.least("r", "s"), B.similarity_bound("r", "s", "o", "o")).alias("positional"), B.dice_distance(F.least("o", "r", "s"), "r", "s").alias("dice"),
    )


@query("helpers_grid", _GRID + """ SELECT r, s, o, u, 1 - CAST(o AS DOUBLE) / (r + s + u - o) AS distance, CAST(r * 1048576 * s AS DOUBLE) / 1048576 AS mebibytes, 'run-' || r || '.' || s AS stem, left(repeat('ab', CAST(s AS INTEGER)), CAST(r AS INTEGER)) AS snip, CAST(3 * r AS BIGINT) AS by_file, least(54 * r, 100 * s) * 1.1::DOUBLE AS by_tokens FROM g""")
def helpers_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark)
    path = F.concat(F.lit("/a.b/run-"), F.col("r").cast("string"), F.lit("."), F.col("s").cast("string"), F.lit(".json"))
    return g.select("r", "s", "o", "u", B.point_distance("o", "r", F.col("s") + F.col("u")).alias("distance"), B.mebibytes(F.col("r") * 1048576 * F.col("s")).alias("mebibytes"), B.file_stem(path).alias("stem"), B.snippet(F.expr("repeat('ab', cast(s as int))"), F.col("r").cast("int")).alias("snip"), B.memory_estimate("r").alias("by_file"), B.memory_estimate("r", "r", F.col("s") * 100).alias("by_tokens"))


@query("split_targets", "SELECT CAST(n.range AS BIGINT) AS records, CAST(greatest(1, ceil(0.005::DOUBLE * n.range)) AS BIGINT) AS target, CAST(greatest(0, ceil(log2(greatest(1, ceil(0.005::DOUBLE * n.range)) / 128))) AS BIGINT) AS levels FROM range(0, 200000, 777) n")
def split_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, *B.split_targets(n, 128)) for n in range(0, 200_000, 777)], "records bigint, target bigint, levels bigint")


query("token_classes", with_elements("customer_parts", "SELECT token, CASE WHEN token <> 0 THEN CAST(bit_count((token & -token) - 1) AS INTEGER) END AS cls, (SELECT CAST(ceil(log2(max(token) + 1)) + 1 AS INTEGER) FROM f) AS classes FROM f"))(lambda s, d: E.token_frequency(pairs_of(s, d, "customer_parts")).select("token", B.token_class("token").cast("int").alias("cls")).crossJoin(pairs_of(s, d, "customer_parts").agg(B.class_count(F.max("token") + 1).alias("classes"))))
query("group_counts", with_elements("customer_parts", "SELECT greatest(1, CAST(round(sqrt(sum(freq) / (2.0 * count(*)))) AS INTEGER)) AS usqrt, greatest(1, CAST(round(sqrt(sum(freq * freq) / (32.0 * sum(freq)))) AS INTEGER)) AS wsqrt FROM f"))(lambda s, d: E.universe_stats(pairs_of(s, d, "customer_parts")).select(B.uniform_group_count("tokens", "universe").alias("usqrt"), B.weighted_group_count("pair_volume", "tokens").alias("wsqrt")))

_CLS = "CASE WHEN token <> 0 THEN CAST(bit_count((token & -token) - 1) AS INTEGER) ELSE -1 END"
_SIG = f"SELECT id, {_CLS} AS cls, string_agg(CAST(token AS VARCHAR), ',' ORDER BY token) AS sig, count(*) AS size FROM p GROUP BY id, 2"
query("signature_index", with_elements("customer_parts", _SIG))(lambda s, d: N.signatures(pairs_of(s, d, "customer_parts")))
query("deletion_index", with_elements("order_parts", f"SELECT a.id, a.cls, coalesce((SELECT string_agg(CAST(b.token AS VARCHAR), ',' ORDER BY b.token) FROM (SELECT id, token, {_CLS} AS cls FROM p) b WHERE b.id = a.id AND b.cls = a.cls AND b.token <> a.token), '') AS sig FROM (SELECT id, token, {_CLS} AS cls FROM p) a"))(lambda s, d: N.deletions(pairs_of(s, d, "order_parts")))
query("signature_cost_order", with_elements("customer_parts", f", g AS ({_SIG}), c AS (SELECT cls, sig, count(*) AS cost FROM g GROUP BY cls, sig) SELECT id, g.cls, g.sig, cost, CAST(row_number() OVER (PARTITION BY id ORDER BY cost, g.cls) AS INTEGER) AS place FROM g JOIN c ON g.cls = c.cls AND g.sig = c.sig"))(lambda s, d: S.signature_cost_order(N.signatures(pairs_of(s, d, "customer_parts"))))

_COUNTS = ", x AS (SELECT id, CAST(token % 16 AS INTEGER) AS b, count(*) AS x FROM p GROUP BY 1, 2), i AS (SELECT DISTINCT id FROM p), d AS (SELECT i.id, z.range AS b, coalesce(x.x, 0) AS x FROM i CROSS JOIN range(0, 16) z LEFT JOIN x ON x.id = i.id AND x.b = z.range)"


def counts_of(spark: SparkSession, sf_dir: str, collection: str) -> DataFrame:
    return N.counters(pairs_of(spark, sf_dir, collection), 16, F.pmod("token", F.lit(16)).cast("int"), "f")


query("fingerprint_counts", with_elements("customer_parts", _COUNTS + " SELECT id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY b) AS f FROM d GROUP BY id"))(lambda s, d: counts_of(s, d, "customer_parts").select("id", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("f")))


@query("fingerprint_bound", with_elements("supplier_parts", _COUNTS + ", m AS (SELECT a.id AS q, b.id AS c, CAST(sum(least(a.x, b.x)) AS BIGINT) AS most, CAST(sum(abs(a.x - b.x)) AS BIGINT) AS apart FROM d a JOIN d b ON a.b = b.b GROUP BY 1, 2), o AS (SELECT a.id AS q, b.id AS c, count(*) AS overlap FROM p a JOIN p b ON a.token = b.token GROUP BY 1, 2) SELECT o.q, o.c, overlap, most, apart, overlap <= most AS holds FROM o JOIN m ON o.q = m.q AND o.c = m.c"))
def fingerprint_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = elements_of(spark, sf_dir, "supplier_parts"), counts_of(spark, sf_dir, "supplier_parts")
    q, c = N.sides(e, None)
    got = N.count_overlaps(q.join(c, "token")).join(f.withColumnsRenamed({"id": "q", "f": "f_q"}), "q").join(f.withColumnsRenamed({"id": "c", "f": "f_c"}), "c")
    apart = F.aggregate(F.zip_with("f_q", "f_c", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("q", "c", "overlap", B.fingerprint_overlap("f_q", "f_c").alias("most"), apart.alias("apart")).withColumn("holds", F.col("overlap") <= F.col("most"))


@query("box_bound", with_elements("supplier_parts", _COUNTS + ", w AS (SELECT id % 8 AS bucket, b, min(x) AS lo, max(x) AS hi FROM d GROUP BY 1, 2) SELECT d.id, bucket, least(1.0::DOUBLE, CAST(sum(least(x, hi)) AS DOUBLE) / CAST(sum(greatest(x, lo)) AS DOUBLE)) AS bound FROM d JOIN w ON d.b = w.b GROUP BY 1, 2"))
def box_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = counts_of(spark, sf_dir, "supplier_parts")
    side = lambda g: F.array(*[g(F.get("f", F.lit(i))) for i in range(16)])
    box = f.groupBy((F.col("id") % 8).alias("bucket")).agg(side(F.min).alias("lo"), side(F.max).alias("hi"))
    return f.crossJoin(F.broadcast(box)).select("id", "bucket", B.box_similarity("f", "lo", "hi").alias("bound"))  # eight boxes


def tenths(spark: SparkSession, sf_dir: str, collection: str) -> DataFrame:
    return pairs_of(spark, sf_dir, collection).select((F.col("id") % 10).cast("int").alias("group_id"), "id").distinct()


query("group_tokens", with_elements("customer_parts", "SELECT DISTINCT CAST(id % 10 AS INTEGER) AS group_id, token FROM p"))(lambda s, d: N.group_tokens(pairs_of(s, d, "customer_parts"), tenths(s, d, "customer_parts")))
query("group_ub_order", with_elements("customer_parts", ", t AS (SELECT DISTINCT CAST(id % 10 AS INTEGER) AS group_id, token FROM p), x AS (SELECT e.id AS q, any_value(e.n) AS n_q, group_id, count(*) AS hits FROM e JOIN t ON e.token = t.token GROUP BY 1, 3) SELECT q, n_q, group_id, hits, CAST(hits AS DOUBLE) / n_q AS bound, CAST(row_number() OVER (PARTITION BY q ORDER BY hits DESC, group_id DESC) AS INTEGER) AS place FROM x"))(lambda s, d: N.group_order(elements_of(s, d, "customer_parts"), tenths(s, d, "customer_parts")).select("q", "n_q", "group_id", "hits", "bound", "place"))


# partitions

def universe(pairs: DataFrame) -> int:
    return int(pairs.agg(F.max("token")).first()[0] or 0) + 1


@query("ptr_embedding", with_elements("customer_parts", """, t AS (SELECT max(token) + 1 AS t FROM p), l AS (SELECT unnest(range(0, CAST(ceil(log2(t)) AS BIGINT))) AS b, t FROM t),
c AS (SELECT id, CAST(2 * b + CAST(floor(token / (t / 2 / pow(2.0, b))) AS BIGINT) % 2 AS INTEGER) AS dim, count(*) AS n FROM p CROSS JOIN l GROUP BY 1, 2) SELECT id, dim, CAST(n AS DOUBLE) / greatest((SELECT max(n) FROM c), 1) AS value FROM c"""))
def ptr_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_of(spark, sf_dir, "customer_parts")
    return P.path_vectors(p, universe(p))


query("initial_groups", with_elements("customer_parts", "SELECT CAST((row_number() OVER (ORDER BY least, id) - 1) // (count(*) OVER () // 128) AS INTEGER) AS group_id, id FROM (SELECT id, min(token) AS least FROM p GROUP BY id)"))(lambda s, d: P.initial_groups(pairs_of(s, d, "customer_parts")))


@query("learned_groups", "SELECT count(DISTINCT id) AS sets, count(DISTINCT id) AS placed, TRUE AS parted FROM (" + PAIRS_SQL["order_parts"] + ")")
def learned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = written(pairs_of(spark, sf_dir, "order_parts"), "pairs")
    return P.partition(p, universe(p), initial=16, learned=True).agg(F.count_distinct("id").alias("sets"), F.count("*").alias("placed"), (F.count_distinct("group_id") >= 16).alias("parted"))


@query("knn_les3_learned", knn_sql("customer_parts"))
def knn_les3_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = written(pairs_of(spark, sf_dir, "customer_parts"), "pairs")
    return N.grouped(p, K, P.partition(p, universe(p), initial=16, share=0.05, learned=True))


_DUAL = """, x AS (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS r FROM f),
y AS (SELECT token, freq, CASE WHEN r // 16 % 2 = 0 THEN r % 16 ELSE 15 - r % 16 END AS f, r // 16 AS w FROM x)
SELECT token, freq, CAST(f AS INTEGER) AS f, CAST(CASE WHEN w // 16 % 2 = 0 THEN w % 16 ELSE 15 - w % 16 END AS INTEGER) AS g FROM y"""
query("dual_groups", with_elements("customer_parts", _DUAL))(lambda s, d: N.dual_groups(E.token_frequency(pairs_of(s, d, "customer_parts"))))


@query("dual_bound", with_elements("supplier_parts", "SELECT a.id AS q, b.id AS c, count(*) AS overlap, TRUE AS holds FROM e a JOIN e b ON a.token = b.token GROUP BY 1, 2"))
def dual_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser bound of the two groupings is one."""
    p = written(pairs_of(spark, sf_dir, "supplier_parts"), "pairs")
    labelled = p.join(N.dual_groups(E.token_frequency(p)).drop("freq"), "token")
    return tiles.fingerprint_bounds(labelled).select("q", "c", "overlap", (F.col("overlap") <= F.col("bound")).alias("holds"))


query("symmetric_difference", with_elements("supplier_parts", "SELECT a.id AS q, b.id AS c, CAST(any_value(a.n) + any_value(b.n) - 2 * count(*) AS BIGINT) AS apart FROM e a JOIN e b ON a.token = b.token GROUP BY 1, 2"))(lambda s, d: N.count_overlaps((lambda q, c: q.join(c, "token"))(*N.sides(elements_of(s, d, "supplier_parts"), None))).select("q", "c", B.symmetric_difference("overlap", "n_q", "n_c").cast("long").alias("apart")))


@query("set_hashes", with_elements("order_parts", "SELECT id, TRUE AS leaves, TRUE AS enters FROM p GROUP BY id"))
def set_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token leaves and enters a set's hash by its own."""
    sets = E.sets(pairs_of(spark, sf_dir, "order_parts"))
    one = F.xxhash64(F.col("tokens")[0])
    less = F.array_remove("tokens", F.col("tokens")[0])
    return sets.select("id", (B.set_hash("tokens").bitwiseXOR(one) == B.set_hash(less)).alias("leaves"), (B.set_hash(F.shuffle("tokens")) == B.set_hash("tokens")).alias("enters"))


@query("split_groups", "SELECT count(DISTINCT id) AS sets, count(DISTINCT id) AS placed FROM (" + PAIRS_SQL["order_parts"] + ")")
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_of(spark, sf_dir, "order_parts")
    return P.partition(p, universe(p), initial=16).agg(F.count_distinct("id").alias("sets"), F.count("*").alias("placed"))


query("dice_distance", with_elements("supplier_parts", "SELECT a.id AS q, b.id AS c, 1 - 2 * CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n)) AS distance FROM e a JOIN e b ON a.token = b.token GROUP BY 1, 2"))(lambda s, d: N.count_overlaps((lambda q, c: q.join(c, "token"))(*N.sides(elements_of(s, d, "supplier_parts"), None))).select("q", "c", B.dice_distance("overlap", "n_q", "n_c").alias("distance")))


# min-hash

_MIN = ", h8 AS (SELECT id, z.range AS h, min(md5(CAST(z.range AS VARCHAR) || ':' || CAST(token AS VARCHAR))) AS value FROM p CROSS JOIN range(0, 8) z GROUP BY 1, 2)"
_CAND = _MIN + ", cand AS (SELECT DISTINCT a.id AS q, b.id AS c FROM h8 a JOIN h8 b ON a.h = b.h AND a.value = b.value)"
query("minhash_signature", with_elements("customer_parts", _MIN + " SELECT id, CAST(h AS INTEGER) AS h, value FROM h8"))(lambda s, d: N.minhash_signature(pairs_of(s, d, "customer_parts")))
query("minhash_candidates", with_elements("customer_parts", _CAND + " SELECT q, c FROM cand"))(lambda s, d: N.minhash_candidates(pairs_of(s, d, "customer_parts")))
_LSH = _CAND + f""", o AS (SELECT cand.q, cand.c, count(*) AS overlap, any_value(a.n) AS nq, any_value(b.n) AS nc FROM cand JOIN e a ON a.id = cand.q JOIN e b ON b.id = cand.c AND b.token = a.token GROUP BY 1, 2),
s AS (SELECT q, c, overlap, CAST(overlap AS DOUBLE) / (nq + nc - overlap) AS similarity FROM o) SELECT q AS query_id, c AS neighbor_id, CAST(overlap AS INTEGER) AS overlap, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) AS rank FROM s) WHERE rank <= {K}"""
query("knn_minhash", with_elements("customer_parts", _LSH))(lambda s, d: N.minhash_join(elements_of(s, d, "customer_parts"), K))
# the queries that the bands leave open are finished exactly; on these tables that is all of them or all but a few
query("knn_puffinn", knn_sql("customer_parts"))(lambda s, d: N.recalled_join(elements_of(s, d, "customer_parts"), K, 0.95))


@query("lsh_recall", knn_sql("customer_parts", select="SELECT count(*) AS matches, TRUE AS reached FROM best"))
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the plan of knn_puffinn reaches a recall of 0.9, measured against all exact matches."""
    e = written(pairs_of(spark, sf_dir, "customer_parts"), "pairs")
    return N.recall(N.recalled_join(e, K, 0.95), N.token_join(e, K)).select("matches", (F.col("recall") >= 0.9).alias("reached"))


# files

@query("set_file_scan", with_elements("order_parts", ", s AS (SELECT id, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY token) AS tokens FROM p GROUP BY id) SELECT row_number() OVER (ORDER BY id) - 1 AS id, tokens FROM s"))
def set_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sets")
    IO.write_sets(E.sets(pairs_of(spark, sf_dir, "order_parts")), path)
    return IO.read_sets(spark, path).select("id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


query("set_metadata", with_elements("order_parts", "SELECT count(DISTINCT id) AS cardinality, max(token) + 1 AS universe FROM p"))(lambda s, d: IO.set_metadata(E.sets(pairs_of(s, d, "order_parts"))))
query("least_tokens", with_elements("order_parts", "SELECT id, min(token) AS least FROM p GROUP BY id"))(lambda s, d: IO.least_tokens(E.sets(pairs_of(s, d, "order_parts"))))


@query("group_file_scan", with_elements("order_parts", "SELECT DISTINCT CAST(id % 10 AS INTEGER) AS group_id, id FROM p"))
def group_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, groups = scratch(spark, "groups"), tenths(spark, sf_dir, "order_parts")
    IO.write_groups(groups, path)
    return IO.check_groups(IO.read_groups(spark, path), groups)


_GROUPS = "(VALUES (0, 1, '1'), (0, 2, '2'), (1, 2, '2'), (1, 9, '9'), (2, NULL, 'x'))"


@query("groups_validation", f"""WITH g(group_id, id, word) AS (SELECT * FROM {_GROUPS}), k(id) AS (VALUES (1), (2), (3))
SELECT 'not a number' AS error, CAST(NULL AS BIGINT) AS id FROM g WHERE id IS NULL UNION ALL SELECT 'out of range', CAST(id AS BIGINT) FROM g WHERE id NOT IN (SELECT id FROM k)
UNION ALL SELECT 'duplicate', CAST(id AS BIGINT) FROM g WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing', CAST(id AS BIGINT) FROM k WHERE id NOT IN (SELECT id FROM g WHERE id IS NOT NULL)""")
def groups_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.sql(f"SELECT CAST(a AS INT) AS group_id, CAST(b AS BIGINT) AS id, c AS word FROM VALUES {_GROUPS[8:-1]} AS t(a, b, c)")
    return IO.group_errors(groups, spark.range(1, 4))


query("group_file_first_lines", with_elements("order_parts", "SELECT DISTINCT CAST(id % 10 AS INTEGER) AS group_id, id FROM p WHERE id % 10 < 3"))(lambda s, d: _first_lines(s, tenths(s, d, "order_parts")))


def _first_lines(spark: SparkSession, groups: DataFrame) -> DataFrame:
    path = scratch(spark, "groups")
    IO.write_groups(groups, path)
    return IO.read_groups(spark, path, most_lines=3).select("group_id", "id")


@query("vector_file_scan", ORACLE_SQL["ptr_embedding"].replace(" SELECT id, dim,", ", v AS (SELECT id, dim,", 1) + ") SELECT id, string_agg(printf('%.6f', value), ' ' ORDER BY dim) AS vector FROM v GROUP BY id")
def vector_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, path = pairs_of(spark, sf_dir, "customer_parts"), scratch(spark, "vectors")
    vectors = P.path_vectors(p, universe(p)).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector"))
    IO.write_vectors(vectors, path)
    return IO.read_vectors(spark, path).select("id", F.array_join(F.transform("vector", lambda v: F.format_string("%.6f", v)), " ").alias("vector"))


@query("vector_errors", with_elements("order_parts", ", i AS (SELECT DISTINCT id FROM p) SELECT 'missing' AS error, id FROM i WHERE id % 7 = 0 UNION ALL SELECT 'duplicate', id FROM i WHERE id % 11 = 0 AND id % 7 <> 0 UNION ALL SELECT 'dimensions', id FROM i WHERE id % 13 = 0 AND id % 7 <> 0 UNION ALL SELECT 'dimensions', id FROM i WHERE id % 13 = 0 AND id % 7 <> 0 AND id % 11 = 0"))
def vector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pairs_of(spark, sf_dir, "order_parts").select("id").distinct()
    good = ids.where("id % 7 != 0").select("id", F.when(F.col("id") % 13 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("vector"))
    return IO.vector_errors(good.unionByName(good.where("id % 11 = 0")), ids, 2)


@query("upserted", """WITH n AS (SELECT o_orderkey AS k, -o_custkey AS v, z.range AS seen FROM orders CROSS JOIN range(0, 3) z WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey, o_custkey, 0 FROM orders WHERE o_orderkey % 5 = 0)
SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS v, CAST(-1 AS BIGINT) AS seen FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT k, v, seen FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seen DESC) AS r FROM n) WHERE r = 1""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("v"))
    again = orders.where("k % 3 = 0").select("k", (-F.col("v")).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("seen"))
    fresh = orders.where("k % 5 = 0").select((-F.col("k")).alias("k"), "v", F.lit(0).cast("long").alias("seen"))
    return IO.upsert(orders.withColumn("seen", F.lit(-1).cast("long")), again.unionByName(fresh), ["k"], "seen")


@query("failures", """SELECT o_orderkey AS id, CAST(o_orderkey % 5 - 2 AS INTEGER) AS exit_code, CASE WHEN o_orderkey % 5 - 2 < 0 THEN 'signal ' || CAST(2 - o_orderkey % 5 AS VARCHAR) ELSE 'exit code ' || CAST(o_orderkey % 5 - 2 AS VARCHAR) END AS reason,
CASE WHEN o_orderkey % 9 > 4 THEN repeat('x', 4) || chr(10) || '...[truncated]' ELSE repeat('x', CAST(o_orderkey % 9 AS BIGINT)) END AS stdout FROM orders""")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_orderkey") % 5 - 2).cast("int").alias("code"), F.expr("repeat('x', cast(o_orderkey % 9 as int))").alias("out"))
    return runs.select("id", V.failure(F.col("code"), F.col("out"), F.lit(""), limit=4).alias("f")).select("id", "f.exit_code", "f.reason", "f.stdout")


_FIELDS = {"algorithm": "string", "k": "int", "mode": "string", "queries": "bigint", "matches": "bigint", "final_k_similarity": "double", "precandidates": "bigint"}


@query("result_document", "SELECT 'baseline' AS algorithm, CAST(" + str(K) + " AS INTEGER) AS k, 'join' AS mode, queries, matches, final_k_similarity, precandidates FROM (" + ORACLE_SQL["join_statistics"] + ")")
def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document as it is written and read back, its fields parsed from the JSON."""
    path = scratch(spark, "document")
    IO.write_document(S.result_document({"algorithm": "baseline", "k": K, "mode": "join"}, join_statistics(spark, sf_dir)), path)
    got = spark.read.text(path)
    at = lambda n: f"$.{'meta' if n in ('algorithm', 'k', 'mode') else 'statistics'}.{n}"
    return got.select(*[F.get_json_object("value", at(n)).cast(t).alias(n) for n, t in _FIELDS.items()])


# stored results

_LABELS = ["full", "les3", "slim"]
_ROWS = [
    (ds, lb, "standard", k, 1, "success", "benchmark", f"2024-01-{day:02d} 00:00:00", 100 * (k + day), 0.0 if (lb, k, ds) == ("les3", 10, "b") else round(1.5 * day + i + k / 10, 3), round(0.5 * i + day, 3), 1000 * i + k, round(k * 1.25 + day, 3), 0.5, 10.0 * day)
    for i, lb in enumerate(_LABELS) for ds in ("a", "b") for k in (5, 10) for day in (1, 2, 3) if not (lb == "full" and ds == "b" and k == 10)
] + [
    ("a", lb, "scalability", 20, c, "success", "benchmark", "2024-02-01 00:00:00", 1000 * c, round(2.0 + 3 * i + c / 8, 3), 1.0, 500, 5.0, 0.25, 1.0) for i, lb in enumerate(_LABELS) for c in (1, 2, 4, 8, 16, 32) if not (lb == "les3" and c == 8)
] + [("a", "slim", "standard", 5, 1, "failed", "benchmark", "2024-03-01 00:00:00", None, None, None, None, None, None, None), ("a", "slim", "standard", 5, 1, "success", "precompute", "2024-03-01 00:00:00", 5, 1.0, 1.0, 1, 1.0, 0.5, 1.0)]
_NAMES = "dataset, label, experiment, k, concurrency, state, phase, run_date, performed, join_time, indexing_time, size_bytes, avg_verifications, k_similarity, read_size"
_CASTS = ["VARCHAR", "VARCHAR", "VARCHAR", "INTEGER", "INTEGER", "VARCHAR", "VARCHAR", "TIMESTAMP", "BIGINT", "DOUBLE", "DOUBLE", "BIGINT", "DOUBLE", "DOUBLE", "DOUBLE"]


def _results_sql() -> str:
    cell = lambda v, t: "CAST(" + ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)) + f" AS {t})"
    rows = ", ".join("(" + ", ".join(cell(v, t) for v, t in zip(r, _CASTS, strict=True)) + ")" for r in _ROWS)
    return f"res({_NAMES}) AS (VALUES {rows}), ok AS (SELECT *, CASE WHEN join_time > 0 THEN performed / join_time END AS throughput FROM res WHERE state = 'success' AND phase = 'benchmark')"


def results(spark: SparkSession) -> DataFrame:
    kinds = {"VARCHAR": "string", "INTEGER": "int", "TIMESTAMP": "timestamp", "BIGINT": "bigint", "DOUBLE": "double"}
    names = _NAMES.split(", ")
    raw = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in _ROWS], ", ".join(f"{n} string" for n in names))
    return raw.select(*[F.col(n).cast(kinds[t]).alias(n) for n, t in zip(names, _CASTS, strict=True)])


def timed(spark: SparkSession, experiment: str) -> DataFrame:
    return V.throughput(V.successful(results(spark))).where(F.col("experiment") == experiment)


_MED = "WITH " + _results_sql() + ", med AS (SELECT label, dataset, k, median(throughput) AS throughput FROM ok WHERE experiment = 'standard' GROUP BY 1, 2, 3), med2 AS (SELECT label, concurrency, median(throughput) AS throughput FROM ok WHERE experiment = 'scalability' GROUP BY 1, 2)"
_REL = _MED + ", rel AS (SELECT m.*, CASE WHEN m.label = 'slim' THEN 1.0::DOUBLE WHEN m.throughput <> 0 THEN b.throughput / m.throughput END AS factor FROM med m LEFT JOIN med b ON b.label = 'slim' AND b.dataset = m.dataset AND b.k = m.k)"
query("throughput_by_k", _MED + " SELECT * FROM med")(lambda s, d: V.median_by(timed(s, "standard"), "throughput", "dataset", "k"))
query("metric_table", _MED + ", m AS (SELECT label, k, median(throughput) AS t FROM ok WHERE experiment = 'standard' GROUP BY 1, 2) SELECT k, max(CASE WHEN label = 'full' THEN t END) AS \"full\", max(CASE WHEN label = 'les3' THEN t END) AS les3, max(CASE WHEN label = 'slim' THEN t END) AS slim FROM m GROUP BY k")(lambda s, d: V.metric_table(V.median_by(timed(s, "standard"), "throughput", "k"), "throughput", "k", _LABELS))
query("collected_values", _MED + " SELECT dataset, string_agg(label || '=' || CAST(CAST(round(t) AS BIGINT) AS VARCHAR), ',' ORDER BY label) AS vals FROM (SELECT label, dataset, median(throughput) AS t FROM ok WHERE experiment = 'standard' GROUP BY 1, 2) GROUP BY dataset")(lambda s, d: V.collected(V.median_by(timed(s, "standard"), "throughput", "dataset"), "throughput", "dataset").select("dataset", F.array_join(F.transform(F.map_entries("values"), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"]).cast("long").cast("string"))), ",").alias("vals")))
query("newest_result", "WITH " + _results_sql() + " SELECT dataset, label, k, run_date FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY k, run_date DESC) AS nr FROM ok WHERE experiment = 'standard') WHERE nr = 1")(lambda s, d: V.newest(timed(s, "standard"), "dataset", "label").select("dataset", "label", "k", "run_date"))
query("relative_factors", _REL + " SELECT label, dataset, k, factor FROM rel")(lambda s, d: V.relative(V.median_by(timed(s, "standard"), "throughput", "dataset", "k"), "throughput", "slim", "dataset", "k").select("label", "dataset", "k", "factor"))
query("relative_times", _MED + ", t AS (SELECT label, dataset, k, median(join_time) AS join_time FROM ok WHERE experiment = 'standard' GROUP BY 1, 2, 3) SELECT m.label, m.dataset, m.k, CASE WHEN m.label = 'slim' THEN 1.0::DOUBLE WHEN b.join_time <> 0 THEN m.join_time / b.join_time END AS factor FROM t m LEFT JOIN t b ON b.label = 'slim' AND b.dataset = m.dataset AND b.k = m.k")(lambda s, d: V.relative(V.median_by(timed(s, "standard"), "join_time", "dataset", "k"), "join_time", "slim", "dataset", "k", higher_is_better=False).select("label", "dataset", "k", "factor"))
query("geo_mean_summary", _REL + " SELECT label, round(avg(factor), 6) AS arithmetic, round(exp(avg(CASE WHEN factor > 0 THEN ln(factor) END)), 6) AS geometric FROM rel GROUP BY label")(lambda s, d: V.means(V.relative(V.median_by(timed(s, "standard"), "throughput", "dataset", "k"), "throughput", "slim", "dataset", "k"), "label"))
query("speedup", _MED + " SELECT m.label, m.concurrency, CASE WHEN b.throughput <> 0 THEN m.throughput / b.throughput END AS speed_up FROM med2 m LEFT JOIN med2 b ON b.label = m.label AND b.concurrency = 1")(lambda s, d: V.speed_up(V.median_by(timed(s, "scalability"), "throughput", "concurrency"), "throughput").select("label", "concurrency", "speed_up"))
query("interval_efficiency", _MED + " SELECT m.label, CAST(m.concurrency AS VARCHAR) || '-' || CAST(w.concurrency AS VARCHAR) AS interval, (w.throughput / m.throughput) / (CAST(w.concurrency AS DOUBLE) / m.concurrency) AS efficiency FROM med2 m JOIN med2 w ON w.label = m.label AND w.concurrency = 2 * m.concurrency WHERE m.throughput <> 0")(lambda s, d: V.interval_efficiency(V.median_by(timed(s, "scalability"), "throughput", "concurrency"), "throughput"))
query("interval_keys", "WITH i(interval) AS (VALUES ('1-2'), ('2-4'), ('16-32'), ('4-8')) SELECT interval, CAST(split_part(interval, '-', 1) AS INTEGER) AS key FROM i")(lambda s, d: s.sql("SELECT * FROM VALUES ('1-2'), ('2-4'), ('16-32'), ('4-8') AS t(interval)").select("interval", V.interval_key(F.col("interval")).alias("key")))


@query("metric_csv", ORACLE_SQL["metric_table"])
def metric_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark, "metrics"), QUERIES["metric_table"](spark, sf_dir)
    IO.write_metrics(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


query("rollup_summary", _REL + " SELECT label, dataset, k, round(avg(factor), 6) AS mean FROM rel GROUP BY GROUPING SETS ((label, dataset), (label, k), (label))")(lambda s, d: V.roll_up(V.relative(V.median_by(timed(s, "standard"), "throughput", "dataset", "k"), "throughput", "slim", "dataset", "k"), "factor"))
query("index_matrix", _MED + ", m AS (SELECT dataset, label, round(median(indexing_time), 3) AS t FROM ok WHERE experiment = 'standard' AND k = 5 GROUP BY 1, 2), w AS (SELECT dataset, max(CASE WHEN label = 'full' THEN t END) AS \"full\", max(CASE WHEN label = 'les3' THEN t END) AS les3, max(CASE WHEN label = 'slim' THEN t END) AS slim FROM m GROUP BY dataset) SELECT * FROM w UNION ALL SELECT 'average', round(avg(\"full\"), 3), round(avg(les3), 3), round(avg(slim), 3) FROM w")(lambda s, d: V.index_matrix(timed(s, "standard"), "indexing_time", _LABELS))
query("run_items", "WITH " + _results_sql() + " SELECT label, CAST(sum(size_bytes) AS BIGINT) AS sum, count(size_bytes) AS count, min(size_bytes) AS min, max(size_bytes) AS max, avg(size_bytes) AS avg FROM ok GROUP BY label")(lambda s, d: S.average_item(V.successful(results(s)), "size_bytes", "label"))

_JOBS = "('p1', 'success', NULL), ('p2', 'failed', NULL), ('j1', 'pending', 'p1'), ('j2', 'pending', 'p2'), ('j3', 'pending', NULL), ('j4', 'running', 'p1'), ('j5', 'skipped', 'p2')"


def jobs(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_JOBS} AS t(job, state, needs)")


_J = f"WITH j(job, state, needs) AS (VALUES {_JOBS})"
query("state_counts", _J + " SELECT state, count(*) AS jobs FROM j GROUP BY state")(lambda s, d: V.state_counts(jobs(s)))
query("scheduler_status", _J + ", x AS (SELECT *, needs IS NULL OR needs IN (SELECT job FROM j WHERE state = 'success') AS ok FROM j) SELECT count(*) FILTER (state = 'pending' AND ok) AS ready, count(*) FILTER (state = 'pending' AND NOT ok) AS blocked, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'success') AS success, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped FROM x")(lambda s, d: V.status(jobs(s)))
query("unblocked_jobs", _J + " SELECT job FROM j WHERE state = 'pending' AND needs IN (SELECT job FROM j WHERE state = 'success')")(lambda s, d: V.unblocked(jobs(s)).select("job"))
query("job_order", "SELECT *, row_number() OVER (ORDER BY stage, memory, algorithm, dataset, k) - 1 AS place FROM (SELECT CAST(o_orderkey % 3 AS INTEGER) AS stage, CAST(o_custkey AS BIGINT) AS memory, o_orderpriority AS algorithm, o_orderstatus AS dataset, CAST(o_orderkey AS BIGINT) AS k FROM orders)")(lambda s, d: V.job_order(table(s, d, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("stage"), F.col("o_custkey").cast("long").alias("memory"), F.col("o_orderpriority").alias("algorithm"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").cast("long").alias("k"))))
query("job_plan", "SELECT a.column0 AS algorithm, d.column0 AS dataset, r.column0 AS experiment, CAST(r.column1 AS INTEGER) AS requested_k, CAST(r.column1 + 1 AS INTEGER) AS actual_k, CAST(r.column2 AS INTEGER) AS concurrency, CAST(10000 * r.column2 AS INTEGER) AS sample_size FROM (VALUES ('slim'), ('full'), ('les3')) a(column0), (VALUES ('a'), ('b')) d(column0), (VALUES ('standard', 5, 1), ('standard', 10, 1), ('standard', 20, 1), ('standard', 40, 1), ('standard', 80, 1), ('scalability', 20, 2), ('scalability', 20, 4), ('scalability', 20, 8), ('scalability', 20, 16), ('scalability', 20, 32)) r(column0, column1, column2)")(lambda s, d: V.job_plan(s, ["slim", "full", "les3"], ["a", "b"]))
