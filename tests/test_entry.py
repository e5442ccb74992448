"""The registry with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in E.queries()))"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_registry_without_training_data(tmp_path, left):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=lambda d, names: {n for n in names if n in (".git", "__pycache__") or os.path.basename(d) in ("tavola", "tests") and n == "llm"
                                                         or os.path.samefile(d, REPO) and n == "corpus_pipeline.py" and n not in left})
    assert not (copy / "tavola/llm").exists() and (copy / "corpus_pipeline.py").exists() == bool(left)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
    shown = run(SHOW)
    assert shown.returncode == 0, shown.stderr
    n, sql, of_llm = map(int, shown.stdout.split())
    assert n > 120 and sql > 110 and of_llm == 0
    assert run("import bench").returncode == 0
