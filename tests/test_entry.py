"""The driver's contract, and independence from the subpackage of training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "hotspot_top_fraction" in entry.queries()


def test_imports_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['orelode.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 30 and out[1] == "False"


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "orelode").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "orelode.llm" not in path.read_text(), path
