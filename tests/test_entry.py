import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_registry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and o.keys() <= q.keys()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "event_id" and df.count() > 0
