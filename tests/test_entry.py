"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__  # noqa: F401  fills the registry
from naskah.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n')"


def names(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_without_the_folders(tmp_path):
    """Without ``llm``, with and without the pipeline file, all other queries are left."""
    shutil.copytree(os.path.join(ROOT, "naskah"), tmp_path / "naskah", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    assert names(tmp_path) == set(registry.QUERIES)
    (tmp_path / "corpus_pipeline.py").write_text("from naskah.llm import bpe\n")
    assert names(tmp_path) == set(registry.QUERIES)
    assert len(registry.QUERIES) >= 162
