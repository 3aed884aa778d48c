"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout) >= 211


def test_catalog_part_stands_alone():
    for path in (ROOT / "starloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "starloom.llm" not in path.read_text(), path
