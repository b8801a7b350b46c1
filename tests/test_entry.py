"""The entry module with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PRINT_NAMES = "import __spark_entry__ as e; print(*e.queries())"


def names_in(folder):
    found = subprocess.run(
        [sys.executable, "-B", "-c", PRINT_NAMES], cwd=folder, capture_output=True, text=True, check=True,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    return set(found.stdout.split())


@pytest.mark.parametrize("without", [("threatloom/llm",), ("threatloom/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_import_without_the_training_data_operators(tmp_path, without):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(
        ".git", "tests", "__pycache__", *[w.split("/")[-1] for w in without]))
    names = names_in(copy)
    assert {"coverage_pivot", "corpus_build"} <= names and "pipeline" not in names
    if "threatloom/llm" in without:
        assert not any(name.startswith("op") for name in names)
