"""Pairs counted in tiles against brute force, with blocks of a few tokens."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_knn import brute, elems_of

from setweave.operators import knn as N
from setweave.operators import tiles as T


def random_sets(seed, universe, most, n=60):
    rng = random.Random(seed)
    return {7 * i: set(rng.sample(range(universe), rng.randint(1, most))) for i in range(n)}


def rows_of(df):
    return sorted((r.query_id, r.neighbor_id, r.overlap, r.similarity, r.rank) for r in df.collect())


@pytest.mark.parametrize(("universe", "most", "rows"), [(300, 12, 64), (300, 12, 1 << 21), (9, 8, 50), (9, 8, 1 << 21), (1000, 1, 10)])
def test_token_join_in_tiles(spark, monkeypatch, universe, most, rows):
    """Counted in sparse and in dense portions, and by matrix products where few tokens are in most sets."""
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(T, "ROWS", rows)
    sets = random_sets(universe + most, universe, most)
    elems = elems_of(spark, sets)
    assert rows_of(N.token_join(elems, 4)) == brute(sets, 4)
    some = spark.createDataFrame([(14,), (21,), (21,), (5000,)], "id long")
    assert rows_of(N.token_join(elems, 4, some)) == brute(sets, 4, {14, 21})
    assert rows_of(N.token_join(elems.limit(0), 4)) == []


def test_no_pair_is_shuffled(spark):
    """What meets in a task is a tile's sets; the rows of a token join never are."""
    elems = elems_of(spark, random_sets(1, 50, 10))
    plan = N.token_join(elems, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "overlap" not in plan[plan.index("FlatMapGroupsInArrow") + 200 :]


def test_products_and_counts_agree():
    """Both ways of a tile on frequent tokens, ties and all."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ids = [np.flatnonzero(rng.random(500) < 0.5).tolist() for _ in range(6)]
    table = pa.table({"mine": [True] * 6 + [False] * 6, "token": [str(t) for t in range(6)] * 2, "grp": [0] * 12, "ids": ids + ids})
    tile = T.Tile(table)
    assert tile.dense()
    i, j, o = np.concatenate(tile.products(5), 1)
    x = tile.count(*tile.runs(0, len(tile.q)), 0, len(tile.q))
    at, rank = T.best(x[0], x[1], tile.similarity(*x), 5)
    assert [a[at].tolist() for a in x] == [i.tolist(), j.tolist(), o.tolist()] and rank.max() == 4
    assert sum(len(range(a, b)) for a, b in tile.portions()) == len(tile.q)


def test_recalled_join_verifies_in_tiles(spark, monkeypatch):
    """Candidates of the bands are scored without shuffling pairs with their sets, and rank as exact ones do."""
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(N, "verify", None)
    sets = random_sets(5, 40, 12)
    elems = elems_of(spark, sets)
    assert rows_of(N.recalled_join(elems, 4, 1.0)) == brute(sets, 4)
    banded = rows_of(N.top_k(T.nearest_in_bands(elems, 60, 8, 2), 60))
    assert 0 < len(banded) < len(brute(sets, 60)) and {r[:4] for r in banded} <= {r[:4] for r in brute(sets, 60)}
    assert {(r.q, r.c) for r in N.minhash_candidates(elems, 8, 2).collect()} == {r[:2] for r in banded}


@pytest.mark.parametrize("options", [{"suffix_depth": 2}, {"fingerprint": True}])
def test_filters_of_collections_that_prefixes_do_not_prune(spark, monkeypatch, options):
    """Where most rows would remain, pairs are counted in tiles and none is shuffled to be tested."""
    sets = random_sets(6, 30, 9)
    elems = elems_of(spark, sets)
    monkeypatch.setattr(N, "COUNT_FROM", 2)
    assert rows_of(N.positional(elems, 4, **options)) == brute(sets, 4)
    monkeypatch.setattr(N, "COUNT_FROM", 0)
    monkeypatch.setattr(N, "pruned_join", None)
    monkeypatch.setattr(N, "PROBED", 10)
    seen, seeds = [], N.rare_token_seeds
    monkeypatch.setattr(N, "rare_token_seeds", lambda e, q: (seen.append(q.count()), seeds(e, q))[1])
    assert rows_of(N.positional(elems, 4, **options)) == brute(sets, 4)
    assert len(seen) == 1 and seen[0] < 30  # the thresholds of some queries tell


def test_dual_bounds_in_tiles(spark, monkeypatch):
    """Overlaps and the lesser of the two fingerprints' bounds, pair by pair."""
    monkeypatch.setattr(T, "BLOCK", 40)
    sets = random_sets(7, 40, 12)
    rows = [(i, t, t % 16, t // 16) for i, s in sets.items() for t in s]
    got = T.fingerprint_bounds(spark.createDataFrame(rows, "id long, token long, f int, g int")).collect()
    fit = lambda a, b, of: sum(min(sum(of(t) == x for t in a), sum(of(t) == x for t in b)) for x in range(16))
    want = [(q, c, len(a & b), min(fit(a, b, lambda t: t % 16), fit(a, b, lambda t: t // 16))) for q, a in sets.items() for c, b in sets.items() if a & b]
    assert sorted(map(tuple, got)) == sorted(want)


def test_groups_and_boxes_in_tiles(spark, monkeypatch):
    """Groups whose bound is too low are not counted; all plans agree with brute force."""
    monkeypatch.setattr(T, "BLOCK", 100)
    monkeypatch.setattr(N, "verify", None)
    sets = random_sets(8, 60, 8)
    elems = elems_of(spark, sets)
    groups = spark.createDataFrame([(min(s) % 7, i) for i, s in sets.items()], "group_id int, id long")
    some = spark.createDataFrame([(14,), (21,)], "id long")
    assert rows_of(N.grouped(elems, 4, groups)) == brute(sets, 4)
    assert rows_of(N.grouped(elems, 4, groups, some)) == brute(sets, 4, {14, 21})
    assert rows_of(N.box_join(elems, 4)) == brute(sets, 4)
    assert rows_of(N.box_join(elems, 4, some)) == brute(sets, 4, {14, 21})


def test_a_groups_bound_prunes():
    """With copies in the best group, no set of a group that has one of the tokens only is counted."""
    import pyarrow as pa

    ids, grps = [[1, 2, 3, 4], [1, 2, 3], [4]], [[0, 0, 0, 1], [0, 0, 0], [1]]
    table = pa.table({"mine": [True, True] + [False] * 3, "token": [1, 2, 1, 2, 3], "ids": [[1], [1], *ids], "grps": [[0], [0], *grps]})
    tile, seen = T.Tile(table), []
    count = tile.count
    with pytest.MonkeyPatch.context() as m:
        m.setattr(T, "Tile", lambda *_: tile)
        tile.count = lambda i, run, a, b: (lambda x: (seen.extend(x[1].tolist()), x)[1])(count(i, run, a, b))
        got = T._nearest(3, T._hits, 0, [])(table).to_pylist()
    assert [r["c"] for r in got] == [1, 2, 3] and 3 not in seen


def test_learned_groups_are_searched_in_tiles(spark, monkeypatch):
    """The groups that a partition has learned give the exact neighbours, with no pair verified by its sets."""
    from setweave.operators import partitioning as P

    monkeypatch.setattr(T, "BLOCK", 200)
    monkeypatch.setattr(N, "verify", None)
    sets = random_sets(9, 64, 8, 120)
    elems = elems_of(spark, sets)
    groups = P.partition(elems.select("id", "token"), 64, initial=2, share=0.05, learned=True)
    assert rows_of(N.grouped(elems, 4, groups)) == brute(sets, 4)


def test_a_block_is_shuffled_once_a_pass(spark, monkeypatch):
    """Where ids say nothing of tokens every block meets every part: parts follow one another, and what one has found is written
    before the next, so no block lies on disk once for each that it meets. All pairs are found, whatever the tokens' type."""
    monkeypatch.setattr(T, "BLOCK", 60)
    monkeypatch.setattr(T, "WIDE", 3)
    sets = random_sets(11, 40, 12)
    names, kept = [], T.written
    monkeypatch.setattr(T, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    got = T.nearest(spark.createDataFrame([(i, f"t{t}") for i, s in sets.items() for t in s], "id long, token string"), 60)
    assert rows_of(N.top_k(got, 4)) == brute(sets, 4)
    assert names.count("blocks") == names.count("parts") == 1 and names.count("found") >= 2


def test_hits_of_many_groups_agree(monkeypatch):
    """The share of a query's tokens is the same whether it is counted in cells or by sorting."""
    rng = np.random.default_rng(4)
    ids = np.repeat(np.arange(60), 5)
    sets = T.Sets(ids, pa.array(rng.integers(0, 30, 300)), {}, ids % 37)
    tile = T.Tile.between(sets, T.Index(sets))
    i, run = tile.runs(0, 60)
    dense = T._hits(tile, 0, 60, i, run)
    tile.groups += 1 << 20
    assert (T._hits(tile, 0, 60, i, run) == dense).all() and dense.max() == 1


def test_knn_les3_makes_no_elements(spark, monkeypatch, tmp_path):
    """Groups are searched on (id, token) alone: no frequencies or places are joined to the pairs."""
    from setweave.plans import catalogue as C

    sets = random_sets(12, 60, 8, 140)
    elems = elems_of(spark, sets).select("id", "token")
    monkeypatch.setattr(C, "pairs_of", lambda *_: elems)
    monkeypatch.setattr(C.E, "elements", None)
    assert rows_of(C.QUERIES["knn_les3"](spark, "")) == brute(sets, C.K)


def test_blocks_of_a_written_table_are_packed_once(spark, monkeypatch):
    """As where a recall is measured: two exact searches of one table, the queries of the one being some."""
    sets = random_sets(13, 40, 12)
    elems = T.written(elems_of(spark, sets).select("id", "token"), "pairs")
    names, kept = [], T.written
    monkeypatch.setattr(T, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    some = spark.createDataFrame([(14,), (21,)], "id long")
    assert rows_of(N.token_join(elems, 4, some)) == brute(sets, 4, {14, 21})
    assert rows_of(N.token_join(elems, 4)) == brute(sets, 4)
    assert names.count("parts") == 1 and names.count("blocks") == 2
