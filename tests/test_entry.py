import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_doesnt_import_the_corpus_operators():
    for path in (REPO / "cityflux").rglob("*.py"):
        if "llm" in path.relative_to(REPO / "cityflux").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


@pytest.mark.parametrize("left", ["", "cityflux/llm/__pycache__", "cityflux/llm"])
def test_entry_works_without_the_corpus_operators(tmp_path, left):
    import shutil
    import subprocess
    import sys

    shutil.copytree(REPO / "cityflux", tmp_path / "cityflux", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if left:
        (tmp_path / left).mkdir(parents=True)
        (tmp_path / "corpus_pipeline.py").write_text("")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_top_zones' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False).returncode == 0
