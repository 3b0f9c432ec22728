"""With the llm folders and the pipeline gone, the entry module still imports and offers the other queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "govlake", tmp_path / "govlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'governed_aggregate' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for f in (ROOT / "govlake").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "govlake").parts:
            assert "llm" not in f.read_text(), f
