import subprocess
import sys
from pathlib import Path


def test_import_without_a_session():
    """Modules make no column, window or UDF when they are imported."""
    code = "import __spark_entry__ as e; assert 'pipeline' in e.queries() and 'op4_urls' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True)
