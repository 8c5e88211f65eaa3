import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from lodestone import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_engine_query_has_its_twin():
    assert set(queries.QUERIES) - {"ann_recall"} == set(queries.ORACLE_SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_engine_stands_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.stdout.split()[-2:] == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL))], out.stderr
    # and so do its tests: all are found, and the quick ones run
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/bench.py", tmp_path)
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, capture_output=True, text=True, env=env)
    found = run("--collect-only", "tests")
    assert found.returncode == 0 and "tests/test_engine.py" in found.stdout and "llm" not in found.stdout, found.stdout
    ran = run("tests/test_functions.py")
    assert ran.returncode == 0, ran.stdout


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["chunk_idx", "score", "semantic", "bm25"]
