"""Links and components against all pairs."""

import math

import numpy as np
import pytest

from setweave.llm import vectors as V


def brute(rows, least=0.93):
    fine = [r for r in rows if r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    n = {id(r): 0 for r in rows}
    label = {id(r): id(r) for r in rows}
    links = []
    for i, a in enumerate(fine):
        for b in fine[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    n[id(a)] += 1
                    n[id(b)] += 1
                    links.append((id(a), id(b)))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    out = []
    for r in rows:
        ids = [s[0] for s in rows if label[id(s)] == label[id(r)] and s[0] is not None]
        least_id = min(ids, default=None)
        out.append((r[0], n[id(r)], least_id, r[0] == least_id))
    return sorted(out, key=str)


def rows(seed, dim=12, n=120):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    out = []
    for i in range(n):
        x = base[i % len(base)] + rng.normal(size=dim) * [0, 0.05, 0.25, 2.0][i % 4]
        out.append([i, [float(v) for v in x], int(rng.integers(0, 3))])
    copies = [[200 + i, out[0][1], out[0][2]] for i in range(40)]
    near = [[300 + i, [float(v) for v in base[1] * (1 + i) + rng.normal(size=dim) * 0.01], 1] for i in range(60)]
    odd = [[400, None, 1], [401, [0.0] * dim, 1], [402, [math.nan] * dim, 1], [403, [math.inf] + [0.0] * (dim - 1), 1], [404, [None] + [1.0] * (dim - 1), 1], [405, out[0][1], None], [406, [1.0, 2.0], 1], [407, [2.0, 4.0], 1], [408, [], 1], [None, out[0][1], out[0][2]], [0, out[0][1], out[0][2]], [409, [-1.0, -2.0], 1], [410, [1e-300] * dim, 2], [411, [1e300] * dim, 2], [412, [5.0], 1], [413, [7.0], 1]]
    return [tuple(r) for r in out + copies + near + odd]


@pytest.mark.parametrize("tile", [4096, 16])
@pytest.mark.parametrize("seed", [0, 1])
def test_all_pairs(spark, seed, tile, monkeypatch):
    monkeypatch.setattr(V, "PORTION", 1 << 16 if tile > 100 else 50)
    data = rows(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<double>, label int, cid long, tile string")
    got = sorted(map(tuple, V.near_duplicates(df, tile=tile).collect()), key=str)
    assert got == brute(data)


def test_query_on_planted_links(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 64))
    planted = [base[i % 150] + rng.normal(size=64) * (0.2, 0.3, 0.4, 0.5)[i % 4] for i in range(250)]  # on both sides of 0.93
    data = [(i, [float(v) for v in np.float32(x)], int(i % 3)) for i, x in enumerate([*base, *planted, *base[:40]])]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, V.op9_embeddings(spark, f"file://{tmp_path}").collect()), key=str)
    assert got == brute(data) and sum(r[1] for r in got) > 300


def test_far_clusters_are_not_compared():
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(128, 64)) * 0.02 for c in rng.normal(size=(20, 64))])
    tile = V._Tile(64, 0, 0.93)
    tile.add(np.arange(len(x)), np.ones(len(x), int), x)
    links = sum(int(np.nansum(b.column(2).to_numpy(zero_copy_only=False).astype(float))) for b in tile.end())
    assert links == 20 * 128 * 127 and tile.compared < 0.2 * len(x) * (len(x) - 1) / 2
    on = V._order(x[:, :8])
    assert sorted(on.tolist()) == list(range(len(x)))


def test_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert V.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in V.near_duplicates(df).collect()] == [(1, 0, 1, True)]


def test_rotation_keeps_distances_and_shares_add_up():
    for dim in (1, 3, 8, 64):
        q = V.rotation(dim)
        assert np.allclose(q @ q.T, np.eye(dim))
        parts = V.blocks(dim, 0.93)
        assert parts[0][0].start == 0 and parts[-1][0].stop == dim
        assert 0.14 <= sum(s for _, s in parts) < 0.14 + 1e-9
