"""The driver's contract."""

import importlib.util
import sys

import pytest

import __spark_entry__ as entry


def test_a_missing_subpackage_leaves_the_rest(monkeypatch):
    find = importlib.util.find_spec

    def missing(name):
        if name.startswith("loomfield.llm"):
            raise ModuleNotFoundError(name)
        return find(name)

    monkeypatch.setattr(importlib.util, "find_spec", missing)
    assert "search_hybrid" in entry.queries() and "op1_pii" not in entry.queries()


def test_a_broken_import_is_an_error(monkeypatch):
    if not entry._installed("loomfield.llm.queries"):
        pytest.skip("the subpackage isn't installed")
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setattr(entry, "_installed", lambda module: True)
    with pytest.raises(ImportError):
        entry.queries()
