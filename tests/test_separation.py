"""The library without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
sys.path.insert(0, {at!r})
import __spark_entry__ as entry
from textloom import plans
assert entry.__file__.startswith({at!r})
assert set(entry.queries()) == set(plans.QUERIES), set(entry.queries()) ^ set(plans.QUERIES)
assert set(entry.oracle_sql()) == set(plans.SQL)
"""


@pytest.mark.parametrize("gone", [("textloom/llm", "tests/llm", "corpus_pipeline.py"), ("textloom/llm", "tests/llm")])
def test_without_the_subpackage(tmp_path, gone):
    at = str(tmp_path / "copy")
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = os.path.join(at, name)
        shutil.rmtree(path, ignore_errors=True)
        if os.path.isfile(path):
            os.remove(path)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(at=at)], capture_output=True, text=True, cwd=at, env=environment)
    assert done.returncode == 0, done.stderr


def test_with_a_missing_import(tmp_path):
    """A package that only the subpackage needs isn't there."""
    at = str(tmp_path / "copy")
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    program = f"import sys\nsys.modules['regex'] = None\n{PROGRAM.format(at=at)}"
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, cwd=at, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
