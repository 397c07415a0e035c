import importlib
import sys


def test_entry_works_without_the_optional_parts(monkeypatch, spark):
    for name in [m for m in sys.modules if m.startswith(("tickloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tickloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and not any(n.startswith("op1_") for n in entry.queries())
    assert entry.entry(spark).count() == 5
    sys.modules.pop("__spark_entry__")
