"""Every registered query against its reference SQL."""

import importlib
import sys

import pytest
from oracle_check import compare, connect
from support import SMALL

import __spark_entry__ as entry_module
from adloom.plans import oracles
from adloom.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_registry_and_oracles_agree():
    """Every advertising query has its SQL; the part that can be left out only adds names of its own."""
    assert set(oracles.oracle_sql()) == set(REGISTRY)
    assert set(REGISTRY) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    added = set(entry_module.queries()) - set(REGISTRY)
    assert all(name == "pipeline" or name.startswith("op") for name in added)


def test_entry_without_the_optional_part(monkeypatch):
    """A missing operator part, or a missing library of it, leaves the advertising queries in place."""
    for lacking in ("adloom.llm", "ahocorasick"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith("adloom.llm") or n in ("corpus_pipeline", lacking)]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, lacking, None)
            entry = importlib.reload(entry_module)
            assert set(entry.queries()) == set(REGISTRY) and set(entry.oracle_sql()) == set(REGISTRY)
    importlib.reload(entry_module)


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "rank_by_gmv" in df.columns


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, SMALL)
    assert compare(df, duck, entry_module.oracle_sql()[name]) is None
