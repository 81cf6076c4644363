"""The driver contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from scrivia.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
LISTED = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"


def without(folder: Path, *left_out: str) -> tuple[list[str], list[str]]:
    """Names of queries and oracles in a copy of the tree that lacks some paths."""
    copy = folder / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in left_out:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LISTED], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout
    names, sql = (next(x for x in out.splitlines() if x.startswith(k)).split()[1:] for k in ("NAMES", "SQL"))
    return names, sql


@pytest.mark.parametrize("left_out", [["scrivia/llm", "tests/llm", "corpus_pipeline.py"], ["scrivia/llm", "tests/llm"]])
def test_engine_registers_without_the_training_data_operators(tmp_path, left_out):
    names, sql = without(tmp_path, *left_out)
    assert names == sorted(catalog.queries()) and sql == sorted(catalog.oracle_sql())


def test_every_oracle_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert catalog.queries().keys() <= __spark_entry__.queries().keys()
