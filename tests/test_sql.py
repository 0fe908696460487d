"""Every query gives the rows of its SQL."""

from __future__ import annotations

import check_sql
import pytest

import __spark_entry__ as entry

SLOW = {"image_classifier", "fused_classifier", "run_matrix", "text_classifier"}


@pytest.fixture(scope="module")
def con(sf):
    return check_sql.connect(sf)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_same_rows(spark, con, sf, name):
    assert check_sql.compare(spark, con, sf, name).startswith(("equal", "rows only"))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
