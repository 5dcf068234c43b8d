"""Plans against brute force on small random collections."""

import random

import pytest

from setweave.config import KnnConfig
from setweave.operators import elements as E
from setweave.operators import knn as N


def brute(sets, k, queries=None):
    out = []
    for q, a in sets.items():
        if queries is not None and q not in queries:
            continue
        best = sorted((-len(a & b) / len(a | b), c, len(a & b)) for c, b in sets.items() if a & b)[:k]
        out += [(q, c, o, -s, r) for r, (s, c, o) in enumerate(best, 1)]
    return sorted(out)


def collection(seed):
    rng = random.Random(seed)
    kind = seed % 4
    universe = [12, 16, 8, 40][kind]
    sizes = {0: lambda: rng.randint(1, 8), 1: lambda: rng.randint(1, 16), 2: lambda: 3, 3: lambda: rng.randint(1, 30)}[kind]
    sets = {i: set(rng.sample(range(universe + 1), min(sizes(), universe))) for i in range(1, 24)}
    sets[30], sets[31] = set(sets[1]), set(sets[1])
    sets[40], sets[41] = {0}, {universe}
    return sets


FIXED = {
    "tiny": {0: {1, 2, 4}, 1: {4, 5, 42, 105}, 2: {5, 6, 38, 42, 105}},
    "dupes": {0: {1, 2}, 1: {1, 2}, 2: {1, 2}, 3: {3}},
    "disjoint": {0: {1}, 1: {2}, 2: {3}},
    "power": {0: {1}, 1: {1, 3, 2, 4, 8}},
    "zero": {0: {0}, 1: {0, 1}, 2: {1}},
}

PLANS = {
    "banded": lambda e, k, q: N.banded(e, k, q),
    "token": lambda e, k, q: N.token_at_a_time(e, k, q),
    "slim": lambda e, k, q: N.positional(e, k, q, grouping="identity"),
    "full": lambda e, k, q: N.positional(e, k, q, grouping="wsqrt", full=True),
    "fixed": lambda e, k, q: N.positional(e, k, q, grouping="fixed", suffix_depth=2, fingerprint=True),
    "partition": lambda e, k, q: N.signature_join(e, k, q),
    "palloc": lambda e, k, q: N.signature_join(e, k, q, deletion=True),
    "boxes": lambda e, k, q: N.box_join(e, k, q),
}


def elems_of(spark, sets):
    rows = [(i, t) for i, s in sets.items() for t in s]
    return E.elements(spark.createDataFrame(rows, "id long, token long")).persist()


@pytest.mark.parametrize("seed", range(4))
def test_plans_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "COUNT_FROM", [0, 2][seed % 2])  # counted outright, or verified
    sets = collection(seed)
    e = elems_of(spark, sets)
    want = brute(sets, 3)
    assert sorted(map(tuple, N.token_join(e, 3).collect())) == want
    groups = spark.createDataFrame([(i % 3, i) for i in sets], "group_id int, id long")
    assert sorted(map(tuple, N.grouped(e, 3, groups).collect())) == want
    for name, plan in PLANS.items():
        assert sorted(map(tuple, plan(e, 3, None).collect())) == want, name


def test_fixed_collections(spark):
    for name, sets in FIXED.items():
        e = elems_of(spark, sets)
        for plan in ("slim", "palloc", "boxes"):
            assert sorted(map(tuple, PLANS[plan](e, 10, None).collect())) == brute(sets, 10), (name, plan)


def test_queries_are_some_sets(spark):
    sets = collection(1)
    some = spark.createDataFrame([(3,), (30,), (3,)], "id long")
    e = elems_of(spark, sets)
    for name in ("banded", "full", "partition", "boxes"):
        assert sorted(map(tuple, PLANS[name](e, 2, some).collect())) == brute(sets, 2, {3, 30}), name


def test_empty_collection(spark):
    e = E.elements(spark.createDataFrame([], "id long, token long"))
    for name, plan in PLANS.items():
        assert plan(e, 2, None).collect() == [], name


def test_search_by_configuration(spark):
    sets = collection(0)
    e = elems_of(spark, sets)
    for a in ("baseline", "baselinepp", "topkbaseline", "slim", "eager", "grouping", "partition", "transformation"):
        assert sorted(map(tuple, N.search(e, KnnConfig(k=2, algorithm=a, mode="join")).collect())) == brute(sets, 2), a
    drawn = N.search(e, KnnConfig(k=1, algorithm="baseline", sample_size=5)).collect()
    assert 0 < len({r["query_id"] for r in drawn}) <= 5


@pytest.mark.parametrize("wrong", [{"k": 0}, {"k": 1, "algorithm": "x"}, {"k": 1, "suffix_depth": 3}, {"k": 1, "timeout": -1}, {"k": 1, "algorithm": "les3"}, {"k": 1, "groups": "f", "preprocess": True}, {"k": 1, "mode": "x"}])
def test_configuration_is_checked(wrong):
    with pytest.raises(ValueError):
        KnnConfig(**wrong)


def test_min_hash_finds_equal_sets(spark):
    sets = FIXED["dupes"]
    assert sorted(map(tuple, N.minhash_join(elems_of(spark, sets), 3).collect())) == brute(sets, 3)


def test_min_hash_reaches_its_recall(spark):
    rng = random.Random(9)
    sets = {i: set(rng.sample(range(300), 12)) for i in range(120)}  # low similarities: one hash rarely meets
    e = elems_of(spark, sets)
    exact = N.token_join(e, 3)
    for least in (0.95, 1.0):
        found = N.search(e, KnnConfig(k=3, algorithm="puffinn", mode="join", recall=least))
        assert N.recall(found, exact).first()["recall"] >= least
