"""What may be absent is asked for in the entry module alone."""

import sys
from pathlib import Path

import __spark_entry__
from tidelog.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_the_library_stands_without_its_optional_part():
    for p in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p


def test_the_entry_leaves_out_what_cannot_be_imported(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tidelog.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidelog.llm", None)  # an import of it fails
    assert __spark_entry__.queries().keys() == registry.queries().keys()
    assert __spark_entry__.oracle_sql().keys() == registry.oracle_sql().keys()


def test_every_sql_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
