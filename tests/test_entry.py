"""The driver's contract."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_point

REPO = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["bucket", "event_type", "n", "total", "mean"] and df.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_nothing_else_needs_the_corpus_operators(tmp_path):
    """Without them, the entry point and the rest still import."""
    for name in ("__spark_entry__.py", "sparkloom"):
        os.symlink(REPO / name, tmp_path / name)
    (tmp_path / "sparkloom").unlink()
    (tmp_path / "sparkloom").mkdir()
    for p in (REPO / "sparkloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "sparkloom" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100
