"""The registry: names match SQL, the entry runs, and the rest works without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e
from gazette.plans import manifest

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(manifest.QUERIES) >= 51 and set(manifest.ORACLE_SQL) <= set(manifest.QUERIES)


def test_entry(spark):
    out = e.entry(spark)
    assert out.columns[0] == "lead_id" and out.count() > 0


def test_nothing_outside_imports_the_corpus_operators():
    for p in (ROOT / "gazette").rglob("*.py"):
        if "llm" not in p.parts:
            assert "gazette.llm" not in p.read_text() and "from .llm" not in p.read_text()
    code = "import sys; sys.modules['gazette.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) >= 51; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_broken_import_of_the_corpus_operators_is_no_absence():
    if not (ROOT / "gazette" / "llm").exists():
        return
    code = "import sys; sys.modules['hashlib'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode and "hashlib" in done.stderr
