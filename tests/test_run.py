"""A whole run, its command line, and the exports of stored results."""

import json
import time

import pytest

from setweave.config import KnnConfig
from setweave.operators import evaluation as V
from setweave.plans import run as R
from setweave.plans.catalogue import _LABELS, results
from setweave.sources import files as IO


@pytest.fixture
def sets(tmp_path):
    (tmp_path / "sets.txt").write_text("1 2 4\n4 5 42 105\n5 6 38 42 105\n")
    return str(tmp_path / "sets.txt")


def test_run(spark, sets, tmp_path):
    doc = R.run(spark, sets, KnnConfig(k=2, mode="join"), str(tmp_path / "out"))
    assert doc["meta"]["cardinality"] == 3 and doc["statistics"]["join"]["queries"] == {"requested": 3, "performed": 3, "timed_out": False}
    rows = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["similarity"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(0, 1): (0, 1.0), (0, 2): (1, 1 / 6), (1, 1): (1, 1.0), (1, 2): (2, 0.5), (2, 1): (2, 1.0), (2, 2): (1, 0.5)}
    relabelled = R.run(spark, sets, KnnConfig(k=2, mode="join", preprocess=True, algorithm="partition"))
    assert relabelled["statistics"]["join"]["final_k_similarity"] == doc["statistics"]["join"]["final_k_similarity"]


def test_sample_counts_every_draw(spark, tmp_path):
    (tmp_path / "sets.txt").write_text("1 2 4\n4 5 42 105\n5 6 38 42 105\n")
    doc = R.run(spark, str(tmp_path / "sets.txt"), KnnConfig(k=1, mode="sample", sample_size=50, algorithm="baseline"), str(tmp_path / "out"))
    assert doc["statistics"]["join"] == {"queries": {"requested": 50, "performed": 50, "timed_out": False}, "final_k_similarity": 1.0, "final_heap_size": 50}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_index_statistics_and_times(spark, sets):
    doc = R.run(spark, sets, KnnConfig(k=1, mode="join", algorithm="slim", grouping="aio", preprocess=True))["statistics"]
    assert doc["index"]["list_size"] == {"sum": 12, "count": 8, "min": 1, "max": 2, "avg": 1.5}
    assert doc["index"]["group_count"] == 1
    assert doc["index"]["group_histogram"] == [{"size": n, "count": 1, "weight": n, "group": 0} for n in (3, 4, 5)]
    assert all(doc["timing"][k] > 0 for k in ("preprocessing_time", "indexing_time", "join_time"))


def test_groups(spark, sets, tmp_path):
    (tmp_path / "g.txt").write_text("0 2\n1\n")
    doc = R.run(spark, sets, KnnConfig(k=2, mode="join", algorithm="les3", groups=str(tmp_path / "g.txt")))
    assert doc["statistics"]["join"]["final_heap_size"] == 6
    (tmp_path / "g.txt").write_text("0 2\n")
    with pytest.raises(ValueError, match="missing 1"):
        R.run(spark, sets, KnnConfig(k=2, mode="join", algorithm="les3", groups=str(tmp_path / "g.txt")))


def test_timeout(spark):
    def slow():
        return spark.sparkContext.parallelize(range(4), 4).map(lambda x: time.sleep(30)).count()

    with pytest.raises(R.TimedOut):
        R.within(spark, 2, slow)
    begun = time.time()
    with pytest.raises(R.TimedOut):  # of several jobs, those that start later are cancelled as well
        R.within(spark, 1, lambda: (time.sleep(2), slow()))
    assert time.time() - begun < 25
    assert R.within(spark, 60, lambda: spark.range(3).count()) == 3
    assert R.within(spark, 0, lambda: 5) == 5


def test_command_line(spark, sets, capsys):
    assert R.main(["-f", sets, "-k", "2", "-a", "full", "-g", "fixed", "-m", "join", "-x", "4", "-v", "1", "-l", "x"]) == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["meta"]["label"] == "x" and doc["statistics"]["join"]["queries"]["performed"] == 3
    assert R.main(["-f", sets, "-k", "0"]) == 2


def test_exports(spark, tmp_path):
    tables = V.exports(results(spark), _LABELS)
    assert len(tables) == 8
    IO.write_metrics(tables["throughput"].coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "k,full,les3,slim" and len(lines) == 3
    assert V.selected("slim,both slim", ["slim", "full"], {"both": ["full", "slim"]}) == ["slim", "full"]
    with pytest.raises(ValueError):
        V.selected("none", ["slim"], {})
