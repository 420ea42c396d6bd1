"""Every query of the plant and of runs against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from sheetweave import plans

from .oracle import actual, expected

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    found = plans.QUERIES[name](spark, FOLDER)
    if name not in plans.ORACLE_SQL:
        assert found.count() >= 0
        return
    assert actual(found) == expected(FOLDER, plans.ORACLE_SQL[name])


def test_every_sql_belongs_to_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


@pytest.mark.parametrize("name", ["gr34_group_with_links", "gr35_one_to_one"])
def test_links_cover_all_units(spark, name):
    from sheetweave.plans.run_queries import equipment_drawings

    found = plans.QUERIES[name](spark, FOLDER)
    keys = found.select(found[found.columns[0]].alias("key"))
    assert keys.join(equipment_drawings(spark, FOLDER), "key").select("unit").distinct().count() > 20
