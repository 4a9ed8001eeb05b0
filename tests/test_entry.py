"""The entry points, imported where there is no session yet."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and 'module_summary' in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__ as e

    if Path("/root/testdata/sf0.001").is_dir():
        assert e.entry(spark).columns == ["module", "total", "p1", "p2", "p3", "p4", "health", "top_kinds"]
