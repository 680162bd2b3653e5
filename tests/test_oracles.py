"""Every registered query with an oracle equals its DuckDB SQL (small scale, strict)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as se  # noqa: E402
from check_oracles import compare  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

NAMES = sorted(se.oracle_sql())


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(results, name):
    assert results[name].startswith("OK") and "DTYPES" not in results[name], results[name]


def test_entry_and_contract(spark):
    df = se.entry(spark)
    assert df.columns == ["category", "revenue", "units"] and df.count() > 0
    assert set(se.oracle_sql()) <= set(se.queries())
