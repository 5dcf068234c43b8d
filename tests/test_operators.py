"""Grouping, ranks, partitions, files and evaluation on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.functions.grouping import balanced, group_bounds
from setweave.operators import elements as E
from setweave.operators import evaluation as V
from setweave.operators import partitioning as P
from setweave.sources import files as IO
from setweave.streaming import growing


def test_balanced_split_is_best():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(n, rng.randint(1, 20)) for n in range(1, rng.randint(2, 9))]
        g = rng.randint(1, 5)
        got = balanced(rows, g)
        assert [r for run in got for r in run] == rows and len(got) <= g
        best = min(max(sum(w for _, w in rows[a:b]) for a, b in itertools.pairwise((0, *cut, len(rows)))) for k in range(min(g, len(rows))) for cut in itertools.combinations(range(1, len(rows)), k))
        assert max(sum(w for _, w in run) for run in got) == best


def test_group_bounds_cover_every_size(spark):
    h = spark.createDataFrame([(3, 2, 6), (4, 1, 4), (9, 5, 45)], "n long, sets long, weight long")
    for grouping in ("identity", "aio", "fixed", "wsqrt", "usqrt"):
        rows = group_bounds(h, grouping, 2).collect()
        assert sum(r["sets"] for r in rows) == 8, grouping
        for n in (3, 4, 9):
            assert sum(r["lo"] <= n <= r["hi"] for r in rows) == 1, grouping
    one = spark.createDataFrame([(3, 2, 6)], "n long, sets long, weight long")
    assert [tuple(r) for r in group_bounds(one, "fixed").collect()] == [(0, 3, 5, 2, 6)]
    assert group_bounds(h.limit(0), "aio").collect() == []
    with pytest.raises(ValueError):
        group_bounds(h, "other")


def test_dense_rank_across_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), t) for t in rng.sample(range(1000), 200)]
    got = E.dense_rank_by(spark.createDataFrame(rows, "freq long, token long"), "freq", "token", "rank").collect()
    assert {r["token"]: r["rank"] for r in got} == {t: k for k, (f, t) in enumerate(sorted(rows))}


def test_numbers_of_texts(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice("abz é") for _ in range(rng.randint(0, 5))), k) for k in range(300)]
    got = E.numbered(spark.createDataFrame(rows, "token string, k long").repartition(5), "number", "token", "k").collect()
    assert [(r["token"], r["k"]) for r in sorted(got, key=lambda r: r["number"])] == sorted(rows, key=lambda r: (r[0].encode(), r[1]))
    assert E.numbered(spark.createDataFrame([], "a long"), "n", "a").count() == 0


def test_lines_of_many_stretches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = {f"part-{k}": [f"{k}:{i} " + "x" * (i % 37) for i in range(2000)] for k in range(3)}
    for name, rows in lines.items():
        (tmp_path / "in" / name).write_text("\n".join(rows) + "\n")
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    other.conf.set("spark.sql.files.openCostInBytes", "1k")
    got = IO.numbered_lines(other, str(tmp_path / "in")).orderBy("line").collect()
    assert [tuple(r) for r in got] == list(enumerate(x for name in sorted(lines) for x in lines[name]))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        IO.numbered_lines(spark, str(tmp_path / "none"))


def test_empty_sets_come_last(spark):
    pairs = spark.createDataFrame([(i, 100 - i) for i in range(6)], "id long, token long")
    got = {r["id"]: r["group_id"] for r in P.initial_groups(pairs, 4, spark.range(8)).collect()}
    assert got == {5: 0, 4: 0, 3: 1, 2: 1, 1: 2, 0: 2, 6: 3, 7: 3}


def test_draws_and_samples_are_repeatable(spark):
    ids = spark.range(50).withColumnRenamed("id", "id")
    a, b = (sorted(map(tuple, E.draw_queries(ids, 20, 5).collect())) for _ in range(2))
    assert a == b and len(a) == 20 and all(0 <= x < 50 for _, x in a)
    assert E.draw_queries(ids.limit(0), 3, 1).collect() == []


def test_negative_tokens_are_refused(spark):
    with pytest.raises(Exception, match="negative token"):
        E.validate_tokens(spark.createDataFrame([(1, -2)], "id long, token long")).collect()


def test_set_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("3 1 2 2\n\n5 x 7\n9\n")
    rows = IO.read_sets(spark, str(tmp_path / "s.txt")).orderBy("id").collect()
    assert [(r["id"], r["tokens"]) for r in rows] == [(0, [1, 2, 3]), (1, []), (2, [5]), (3, [9])]
    with pytest.raises(Exception, match="(?i)path"):
        IO.read_sets(spark, str(tmp_path / "none.txt")).collect()


def test_group_files(spark, tmp_path):
    ids = spark.range(4)
    (tmp_path / "g.txt").write_text("0 1\n\n2 3\n")
    groups = IO.read_groups(spark, str(tmp_path / "g.txt"))
    assert IO.check_groups(groups, ids).count() == 4
    assert IO.read_groups(spark, str(tmp_path / "g.txt"), 1).count() == 2
    (tmp_path / "b.txt").write_text("0 0 x\n7 2\n")
    errors = {(r["error"], r["id"]) for r in IO.group_errors(IO.read_groups(spark, str(tmp_path / "b.txt")), ids).collect()}
    assert errors == {("duplicate", 0), ("not a number", None), ("out of range", 7), ("missing", 1), ("missing", 3)}
    with pytest.raises(ValueError):
        IO.check_groups(IO.read_groups(spark, str(tmp_path / "b.txt")), ids)


def test_vector_files(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.0])], "id long, vector array<double>")
    IO.write_vectors(v, str(tmp_path / "v"))
    back = IO.read_vectors(spark, str(tmp_path / "v"))
    assert sorted((r["id"], r["vector"]) for r in back.collect()) == [(1, [0.5, 1.0]), (2, [0.0])]
    assert {(r["error"], r["id"]) for r in IO.vector_errors(back, spark.range(1, 4), 2).collect()} == {("missing", 3), ("dimensions", 2)}


def test_upsert(spark):
    a = spark.createDataFrame([("r", 1, "x"), ("r", 2, "y")], "run string, job int, v string")
    b = spark.createDataFrame([("r", 2, "z"), ("r", 3, "w")], "run string, job int, v string")
    assert sorted(map(tuple, IO.upsert(a, b, ["run", "job"]).collect())) == [("r", 1, "x"), ("r", 2, "z"), ("r", 3, "w")]


@pytest.mark.parametrize("learned", [False, True])
def test_partition_holds_every_set_once(spark, learned):
    rng = random.Random(3)
    pairs = spark.createDataFrame([(i, t) for i in range(600) for t in rng.sample(range(64), 5)], "id long, token long").persist()
    groups = P.partition(pairs, 64, initial=4, share=0.03, learned=learned)
    rows = groups.collect()
    assert sorted(r["id"] for r in rows) == list(range(600))
    assert len({r["group_id"] for r in rows}) > 4
    with pytest.raises(ValueError):
        P.initial_groups(pairs.where("id < 3"), 4)


def test_partition_goes_on_behind_the_last_whole_level(spark, tmp_path):
    rng = random.Random(9)
    pairs = spark.createDataFrame([(i, t) for i in range(400) for t in rng.sample(range(64), 4)], "id long, token long").persist()
    how = {"initial": 2, "share": 0.03, "folder": str(tmp_path)}
    whole = sorted(map(tuple, P.partition(pairs, 64, **how).collect()))
    timings = spark.read.json(str(tmp_path / "timings")).orderBy("level").collect()
    assert [r["level"] for r in timings] == [0, 1, 2] and all(r["seconds"] > 0 for r in timings)
    assert timings[-1]["groups"] == len({g for g, _ in whole})
    (tmp_path / "level-2" / "_SUCCESS").unlink()  # as if the last level had been cut off
    assert sorted(map(tuple, P.partition(pairs, 64, **how).collect())) == whole
    assert sorted(map(tuple, P.partition(pairs, 64, **how).collect())) == whole
    assert sorted(r["level"] for r in spark.read.json(str(tmp_path / "timings")).collect()) == [0, 1, 2, 2]
    assert sorted(map(tuple, P.partition(pairs, 64, initial=2, share=0.03).collect())) == whole


def test_failure_and_order(spark):
    df = spark.createDataFrame([(-9, "o" * 5000, ""), (3, "", "e")], "code int, out string, err string")
    rows = [r["f"] for r in df.select(V.failure(F.col("code"), F.col("out"), F.col("err")).alias("f")).collect()]
    assert rows[0]["reason"] == "signal 9" and rows[0]["stdout"] == "o" * 4000 + "\n...[truncated]" and rows[1]["reason"] == "exit code 3"
    d = spark.createDataFrame([("16-32",), ("2-4",)], "i string")
    assert [r["i"] for r in d.orderBy(V.interval_key(F.col("i"))).collect()] == ["2-4", "16-32"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6)], "id long, token long").withColumn("t", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, token long, t timestamp").parquet(str(tmp_path / "in"))
    q = growing.running_frequency(stream, "t").writeStream.outputMode("complete").format("memory").queryName("freq").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select token, freq from freq").collect())) == [(5, 2), (6, 1)]
    elems = E.elements(spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "id long, token long"))
    q = growing.answer_batches(stream.select("id"), elems, 1, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_net_is_sent_once_for_many_sets(spark, monkeypatch):
    """Chunks of a group go to their sides by the net that comes ahead of them; groups are dealt to tasks by number."""
    rng = random.Random(4)
    pairs = spark.createDataFrame([(i, t) for i in range(500) for t in rng.sample(range(64), 5)], "id long, token long").persist()
    whole = sorted(map(tuple, P.partition(pairs, 64, initial=4, share=0.03, learned=True).collect()))
    monkeypatch.setattr(P, "CHUNK", 7)
    names, kept = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    assert sorted(map(tuple, P.partition(pairs, 64, initial=4, share=0.03, learned=True).collect())) == whole
    assert names.count("vectors") == 1 and names.count("nets") == names.count("level-0") + names.count("level-1")


def test_dice_distances_of_pairs():
    sets = [[1, 2, 3], [2, 3], [7], [1, 7, 9000000000]]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(4) for b in range(4) if a != b], strict=True))
    want = [1 - 2 * len(set(sets[a]) & set(sets[b])) / (len(sets[a]) + len(sets[b])) for a, b in zip(i, j, strict=True)]
    assert P.dice_distances(sets, i, j).tolist() == want


def test_groups_that_fit_a_task_are_split_there(spark, monkeypatch, tmp_path):
    """No job for each level: a task halves its group to the last level and gives the groups that jobs by level give."""
    rng = random.Random(6)
    pairs = spark.createDataFrame([(i, t) for i in range(900) for t in rng.sample(range(64), 6)], "id long, token long").persist()
    names, kept, how = [], P.written, {"initial": 2, "share": 0.02, "learned": True}
    want = sorted(map(tuple, P.partition(pairs, 64, folder=str(tmp_path), **how).collect()))  # four levels, job by job
    monkeypatch.setattr(P, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    assert sorted(map(tuple, P.partition(pairs, 64, **how).collect())) == want
    assert names.count("leaves") == 1 and "nets" not in names
    monkeypatch.setattr(P, "CHUNK_TOKENS", 250 * 6)  # groups of 450 sets go by level first
    assert sorted(map(tuple, P.partition(pairs, 64, **how).collect())) == want
    assert 0 < names.count("nets") < 4


def test_counters_as_arrays(spark):
    pairs = spark.createDataFrame([(i, t) for i, s in enumerate(([0], [1, 2, 39], list(range(40)), [7, 20])) for t in s], "id long, token long")
    dense = {r["id"]: r for r in P.with_counters(pairs, 40).collect()}
    assert [dense[i]["n"] for i in range(4)] == [1, 3, 40, 2] and {len(r["x"]) for r in dense.values()} == {P.B.path_dimensions(40)}
    counted = P.path_counters(pairs, 40).collect()
    assert sum(sum(r["x"]) for r in dense.values()) == sum(r["count"] for r in counted)
    assert all(dense[r["id"]]["x"][r["dim"]] == r["count"] for r in counted)
