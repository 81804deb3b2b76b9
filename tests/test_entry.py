"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_folders(tmp_path):
    """A copy without ``farebox/llm`` lists every other query, whether or not the pipeline's file is there."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(REPO, name)):
            shutil.copy(os.path.join(REPO, name), tmp_path)
    for name in ("farebox", "catalog"):
        shutil.copytree(os.path.join(REPO, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = (
        "import __spark_entry__ as e; from catalog import registry;"
        "assert set(e.queries()) == set(registry()), set(e.queries()) ^ set(registry());"
        "assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100
