"""The driver's entry points."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_works_without_the_subpackage(tmp_path, gone):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))  # setweave/llm and tests/llm
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    python(to, "-c", code)
    # the core's own tests, as far as they are quick
    python(to, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_operators.py", "tests/test_knn.py", "-k", "balanced or configuration_is_checked or negative or group_files")


@pytest.mark.parametrize("library", ["xxhash", "ahocorasick"])
def test_works_without_a_library_of_the_subpackage(tmp_path, library):
    (tmp_path / f"{library}.py").write_text(f"raise ImportError('no {library}')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'knn_partition' in q; e.oracle_sql()"
    python(ROOT, "-c", code, first=str(tmp_path))


def python(at, *args, first=""):
    subprocess.run([sys.executable, *args], cwd=at, check=True, env={**os.environ, "PYTHONPATH": f"{first}:{at}"})
