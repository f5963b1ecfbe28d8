import importlib
import importlib.util


def test_entry_works_without_the_text_operators(monkeypatch):
    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("lattica.llm", "corpus_pipeline")) else real(name, *a))
    e = importlib.reload(__spark_entry__)
    assert "qc_norm_log1p" in e.queries() and not any(n.startswith("op") for n in e.queries())
    assert set(e.oracle_sql()) < set(e.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
