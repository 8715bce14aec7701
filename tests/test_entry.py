"""The driver contract, with and without the training-text operators."""

import importlib
import sys


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_text_operators(monkeypatch):
    import __spark_entry__ as e

    try:
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith("veilwork.llm")] + ["veilwork.llm", "veilwork.llm.queries", "corpus_pipeline"]:
                m.setitem(sys.modules, name, None)
            importlib.reload(e)
            names = e.queries()
            assert names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
            assert set(e.oracle_sql()) <= set(names)
    finally:
        importlib.reload(e)


def test_flagship_query(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
