import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _copy(to, *left_out):
    shutil.copytree(ROOT, to, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), ROOT) in left_out])


def test_entry_without_the_training_operators(tmp_path):
    """With the folders gone, with and without the pipeline's file, the other queries load."""
    for k, gone in enumerate((("quillsift/llm", "tests/llm"), ("quillsift/llm", "tests/llm", "corpus_pipeline.py"))):
        _copy(tmp_path / str(k), *gone)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'findings_all' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / str(k), capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert done.returncode == 0, done.stderr
