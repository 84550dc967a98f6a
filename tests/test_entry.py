"""The driver's entry with and without the libraries that the optional queries need."""

import sys

import pytest

import __spark_entry__ as entry_points
from quorumlab.catalog import load


@pytest.mark.parametrize("missing", ["xxhash", "public_tokenizers", "tokenizers", "regex", "tiktoken", "quorumlab.llm"])
def test_core_queries_stay_without_an_optional_library(monkeypatch, missing):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quorumlab.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert entry_points.queries().keys() == load()[0].keys()
    assert entry_points.oracle_sql().keys() == load()[1].keys()


def test_every_core_query_has_a_twin():
    queries, oracles = load()
    assert queries.keys() == oracles.keys()
