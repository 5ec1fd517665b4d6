"""The driver's entry module, with and without the subpackage llm."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry
import pixelframe


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "y", "x", "r", "g", "b", "a"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["pixelframe.llm", "zstandard", "corpus_pipeline"])
def test_without_llm(monkeypatch, missing):
    """Without the subpackage, the pipeline, or what either needs, the engine's queries are still there."""
    for name in [m for m in sys.modules if m.startswith("pixelframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    if hasattr(pixelframe, "llm"):
        monkeypatch.delattr(pixelframe, "llm")
    monkeypatch.setitem(sys.modules, missing, None)
    names = entry.queries()
    assert "sniff" in names and "pipeline" not in names
    assert missing == "corpus_pipeline" or not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= set(names)
