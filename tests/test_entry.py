import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def run(cwd, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=cwd, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(cwd)}, timeout=120)


def test_imports_without_the_text_subpackage(tmp_path):
    shutil.copytree(ROOT / "pelagia", tmp_path / "pelagia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    got = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert 'zone_violation' in q and not [n for n in q if n.startswith('op')]; print(len(q), len(e.oracle_sql()))")
    assert got.returncode == 0, got.stderr
    assert int(got.stdout.split()[0]) > 40


def test_imports_with_the_folders_deleted_or_left_over(tmp_path):
    """corpus_pipeline.py is there or not, and the subpackage is gone or an empty folder: the rest works."""
    count = "import __spark_entry__ as e; q = e.queries(); assert 'zone_violation' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; print(len(q))"
    shutil.copytree(ROOT / "pelagia", tmp_path / "pelagia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for _ in ("gone", "left over"):
        got = run(tmp_path, count)
        assert got.returncode == 0 and int(got.stdout) > 40, got.stderr
        (tmp_path / "pelagia" / "llm" / "__pycache__").mkdir(parents=True, exist_ok=True)


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copytree(ROOT / "pelagia", tmp_path / "pelagia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_missing\n")
    assert "a_library_that_is_missing" in run(tmp_path, "import __spark_entry__").stderr


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
