import importlib
import re
import shutil
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "p2_found" in q and len(q) > 50


def test_layers():
    """The core never imports the training-data subpackage."""
    for p in (ROOT / "brindle").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import) brindle\.llm", p.read_text(), re.M), p


def test_core_without_llm(tmp_path):
    shutil.copytree(ROOT / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; n = e.queries(); assert 'p2_found' in n and 'p1_found' not in n; print(len(n))"
    import subprocess

    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}).returncode == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["site", "page", "day", "clicks", "total_7", "avg_7", "total_30", "avg_30"] and df.count() > 0
    importlib.reload(entry)
