"""The driver contract: names, oracle coverage, entry()."""

import inspect
import re

import __spark_entry__ as se


def test_names_and_oracles():
    qs, ors = se.queries(), se.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(ors) >= 70
    for name in qs:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)
    for sql in ors.values():
        assert any(t in sql for t in ("catalog AS (", "conversations", "documents", "embeddings"))


def test_callables_take_spark_and_dir():
    for fn in se.queries().values():
        params = list(inspect.signature(fn).parameters)
        assert len(params) == 2
