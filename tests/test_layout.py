from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_stands_without_the_subpackage():
    code = "import sys; sys.modules['quern.llm'] = None; import __spark_entry__ as e; n = set(e.queries()); assert 'pricing_summary' in n and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in n); assert set(e.oracle_sql()) <= n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.joinpath("quern").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("quern.llm``", ""), path
