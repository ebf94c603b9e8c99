"""The driver's contract, with and without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_import_without_the_corpus_operators(tmp_path, pipeline):
    for p in ("__spark_entry__.py", "utterframe", *["corpus_pipeline.py"] * pipeline):
        if not (REPO / p).exists():
            continue
        (shutil.copytree if (REPO / p).is_dir() else shutil.copy)(REPO / p, tmp_path / p)
    shutil.rmtree(tmp_path / "utterframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op1') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for p in (REPO / "utterframe").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "utterframe.llm" not in p.read_text()
