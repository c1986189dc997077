"""The rest works without this subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_without_the_subpackage(tmp_path):
    for name in ("termweave", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "termweave" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_it():
    files = [f for f in (ROOT / "termweave").rglob("*.py") if "llm" not in f.parts]
    assert files and not [f for f in files if "termweave.llm" in f.read_text() or "corpus_pipeline" in f.read_text()]
