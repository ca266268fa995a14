import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_the_pipeline(tmp_path):
    shutil.copytree(ROOT / "plenum", tmp_path / "plenum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'recent_averages' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for p in (ROOT / "plenum").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "plenum.llm" not in p.read_text()
