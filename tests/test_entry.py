"""The driver's contract holds where the optional part isn't there."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).parent.parent


@pytest.mark.parametrize("other", [False, True])
@pytest.mark.parametrize("gone", [["lumenloft/llm", "tests/llm"], ["lumenloft/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_without_optional_part(tmp_path, gone, other):
    """other: with a whole second copy further back on the path, which mustn't be used."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": str(ROOT)} if other else {})
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        p = copy / name
        if p.is_dir():
            shutil.rmtree(p)
        elif p.exists():
            p.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'day_summary' in q and 'pipeline' not in q; print(sum(k.startswith('op') and k[2].isdigit() for k in q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env=env)
    assert run.returncode == 0, run.stderr
    if "lumenloft/llm" in gone:
        assert run.stdout.split() == ["0"]
    if (copy / "tests").exists():
        seen = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "--ignore=tests/llm"], cwd=copy, capture_output=True, text=True, timeout=120, env=env)
        assert seen.returncode == 0, seen.stdout + seen.stderr
