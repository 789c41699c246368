"""The entry point without the training-data subpackage: everything else is there."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k.startswith('op') and k[2].isdigit() or k == 'pipeline')); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_imports_without_llm(tmp_path, pipeline):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copytree(os.path.join(ROOT, "tablecraft"), copy / "tablecraft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) else [])]:
        shutil.copy(os.path.join(ROOT, name), copy / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, env=env, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    n, extra = done.stdout.split(" ", 1)
    assert int(n) >= 85 and extra.strip() == "[]"
