"""Every registered query against its DuckDB oracle (sf0.001), plus the entry point."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from gradebook.plans import registry  # noqa: E402
from oracle_check import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
registry.load_all()


def test_every_query_has_an_oracle():
    assert set(registry.ORACLE) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "win", "loss", "tie", "win_rate", "loss_rate"] and len(rows) > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res[0] == "OK", res
