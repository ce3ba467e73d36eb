"""Every registered query against its DuckDB oracle (rows-only where there is none)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare
from tidemark.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF, list(REGISTRY), verbose=False)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(results, name):
    res = results[name]
    assert res == "OK" or res.startswith("rows-only"), res


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_count"] > 0


def test_every_query_has_an_oracle_or_is_known_rows_only():
    rows_only = set(REGISTRY) - set(E.oracle_sql())
    assert rows_only <= {"vector_topk_lsh", "vector_topk_ivf", "vector_index_search", "vector_index_recall", "market_snapshot"}
