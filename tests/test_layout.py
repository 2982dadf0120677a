import ast
import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""


def test_nothing_imports_llm():
    for path in (ROOT / "tamarack").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any(name.startswith("tamarack.llm") for name in imports(path)), path


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("tamarack.llm"):
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    names = set(entry.queries())
    assert "p1_found" in names and "p4_found" not in names
    assert set(entry.oracle_sql()) <= names
    assert "tamarack" in sys.modules


def test_every_query_has_a_known_name():
    from tamarack.plans import registry

    assert len(registry.templates()) == 179
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["category_id", "root_id", "depth", "place", "path"] and df.count() > 0
