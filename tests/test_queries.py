"""Every registered query beside its SQL, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import oracle  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402
from tableward.plans.registry import Tables, load_all  # noqa: E402

REGISTRY = load_all()


@pytest.fixture(scope="module")
def duck(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, duck, small, name):
    query = REGISTRY[name]
    df = query.build(Tables(spark, small))
    if query.sql:
        same, note = oracle.compare(df, duck, query.sql)
        assert same, note
    else:
        assert df.count() > 0


def test_entry_points(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
