"""The entry points with and without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)
HIDDEN = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("deckwright.llm"):
            raise ModuleNotFoundError(name, name=name if name == "corpus_pipeline" else "deckwright.llm")
sys.meta_path.insert(0, Hidden())
"""
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def run(code: str) -> list[str]:
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_training_data_operators():
    queries, oracles, some = run(HIDDEN + SHOW)
    assert int(queries) >= 50 and int(oracles) >= 46 and some == "False"


def test_nothing_else_imports_them():
    for path in Path(REPO, "deckwright").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
