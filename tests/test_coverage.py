"""Every operator family has a query or a test, and the catalogue hangs together."""

import ast
from pathlib import Path

import turnloom

TOP = Path(turnloom.__file__).parent


def test_nothing_outside_imports_the_corpus_package():
    for p in TOP.rglob("*.py"):
        if "llm" in p.relative_to(TOP).parts:
            continue
        names = {n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)} | {a.name for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.Import) for a in n.names}
        assert not any(n.startswith("turnloom.llm") or n == "corpus_pipeline" for n in names), p


def test_oracles_belong_to_queries():
    from turnloom.plans.queries import ORACLE, QUERIES

    assert set(ORACLE) <= set(QUERIES) and len(ORACLE) >= 45


def test_entry_works_without_the_corpus_package(tmp_path):
    """A copy without the corpus package and its pipeline still imports and lists its own queries."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(TOP, tmp_path / "turnloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP.parent / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clip_manifest' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
