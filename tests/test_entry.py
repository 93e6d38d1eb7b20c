import shutil
import subprocess
import sys
import types
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quillon import catalogue

REPO = Path(entry.__file__).resolve().parent


def test_missing_modules_are_left_out():
    assert entry._optional("quillon.no_such_part.queries") is None
    assert entry._optional("no_such_pipeline") is None


def test_errors_inside_modules_are_not_hidden(monkeypatch, tmp_path):
    (tmp_path / "broken_part.py").write_text("import no_such_library\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_part")


def test_names_of_queries_and_sql_match(monkeypatch):
    queries = types.SimpleNamespace(queries=lambda: {"op": None}, oracle_sql=lambda: {})
    parts = {"quillon.llm.queries": queries, "corpus_pipeline": types.SimpleNamespace(run=lambda spark, d: None, ORACLE_SQL=None)}
    monkeypatch.setattr(entry, "_optional", parts.get)
    assert {"op", "pipeline"} <= set(entry.queries()) and "pipeline" not in entry.oracle_sql()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leftovers", [True, False])
def test_entry_without_the_text_operators(tmp_path, pipeline, leftovers):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache", *[] if pipeline else ["corpus_pipeline.py"]))
    if leftovers:
        (copy / "quillon" / "llm" / "__pycache__").mkdir(parents=True)
    say = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    queries, sql = subprocess.run([sys.executable, "-c", say], cwd=copy, check=True, capture_output=True, text=True).stdout.splitlines()
    assert queries.split() == sorted(catalogue.queries()) and sql.split() == sorted(catalogue.oracle_sql())
