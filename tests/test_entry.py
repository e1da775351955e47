"""The entry module with all its parts and without those that may be left out."""

import itertools
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

HERE = Path(__file__).resolve().parents[1]
OPTIONAL = ["kadastra/llm", "corpus_pipeline.py"]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def _copied(to, gone=(), files=("kadastra", "corpus_pipeline.py", "__spark_entry__.py")):
    for f in files:
        if (HERE / f).is_dir():
            shutil.copytree(HERE / f, to / f, ignore=lambda d, names: [n for n in names if n == "__pycache__" or f"{Path(d).relative_to(HERE)}/{n}" in gone])
        elif f not in gone and (HERE / f).exists():
            shutil.copy(HERE / f, to / f)


def _counted(at):
    return tuple(map(int, subprocess.run([sys.executable, "-c", COUNT], cwd=at, capture_output=True, text=True, check=True).stdout.split()))


@pytest.mark.parametrize("gone", [c for n in (1, 2) for c in itertools.combinations(OPTIONAL, n)])
def test_queries_without_optional_parts(tmp_path, gone):
    _copied(tmp_path, gone)
    n, n_sql, n_op = _counted(tmp_path)
    own = [q for q in __spark_entry__.queries() if not q.startswith("op") and q != "pipeline"]
    assert n - n_op == len(own) and n_sql > 150
    assert n_op == (0 if "kadastra/llm" in gone else n_op)


@pytest.mark.parametrize("broken", ["kadastra/llm/__init__.py", "kadastra/llm/queries.py", "corpus_pipeline.py"])
def test_queries_with_a_part_that_can_not_be_imported(tmp_path, broken):
    if not (HERE / broken).exists():
        pytest.skip("left out")
    _copied(tmp_path)
    (tmp_path / broken).write_text("import a_module_that_is_not_here\n")
    n, n_sql, n_op = _counted(tmp_path)
    own = [q for q in __spark_entry__.queries() if not q.startswith("op") and q != "pipeline"]
    assert n - n_op == len(own) and n_sql > 150
    assert n_op == (0 if "llm" in broken else sum(q.startswith("op") for q in __spark_entry__.queries()))


def test_tests_are_collected_without_optional_parts(tmp_path):
    _copied(tmp_path, [*OPTIONAL, "tests/llm"], ("kadastra", "__spark_entry__.py", "tests"))
    out = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stdout[-2000:]
