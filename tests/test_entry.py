import importlib
import sys

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "payment_reconcile" in entry.queries()


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_imports_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("recordloom.llm")] + ["corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    module = importlib.reload(entry)
    assert "payment_reconcile" in module.queries() and not any(q.startswith("op") for q in module.queries())
    monkeypatch.undo()
    importlib.reload(entry)
