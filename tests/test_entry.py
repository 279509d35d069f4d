"""The entry module stands without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'))"


def said(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True).stdout


@pytest.mark.parametrize("gone", [("tradewire/llm",), ("tradewire/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_core_without_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT / "tradewire", tmp_path / "tradewire", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    from tradewire import catalog

    out = said(tmp_path)
    assert int(out.split()[0]) >= len(catalog.queries()) and "pipeline" not in out
    if "tradewire/llm" in gone:
        assert out.split(maxsplit=2)[2].strip() == "[]"


def test_nothing_else_imports_them():
    for path in ROOT.glob("tradewire/**/*.py"):
        if "llm" not in path.parts:
            assert "tradewire.llm" not in path.read_text(), path


def test_library_that_is_missing(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import sys; sys.path.insert(0, %r); sys.path.insert(1, %r); " % (str(tmp_path), str(ROOT)) + SAY
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[0]) > 100


def test_pipeline_of_another_copy_is_not_taken(tmp_path, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", str(ROOT))
    test_core_without_corpus_operators(tmp_path, ("corpus_pipeline.py",))
    assert "pipeline" in said(ROOT)
