"""The entry without the training-data operators, and with a broken import among them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT / "scriptorium", tmp_path / "scriptorium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    got = run(tmp_path, "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))")
    assert got.stdout.split()[1:] == ["False", "True"] and int(got.stdout.split()[0]) > 100, got.stderr


def test_a_broken_import_is_an_error(tmp_path):
    shutil.copytree(ROOT / "scriptorium", tmp_path / "scriptorium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "scriptorium" / "llm").mkdir()
    (tmp_path / "scriptorium" / "llm" / "__init__.py").write_text("")
    (tmp_path / "scriptorium" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in run(tmp_path, "import __spark_entry__").stderr
