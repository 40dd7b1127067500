"""Every query of the catalogue against its SQL, over whole tables."""

import pytest

from plumbline.plans import catalogue
from tests.compare import assert_same
from tests.conftest import DATA

ALL = catalogue.queries()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    got = ALL[name](spark, DATA)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert_same(got.toPandas(), duck.execute(sql).fetchdf())
    else:
        assert got.count() > 0


def test_entry_has_the_catalogue(spark):
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_greedy_audit_fills_the_labels_that_lack_most(spark):
    rows = ALL["audit_greedy"](spark, DATA).toPandas()
    assert len(rows) == 60 and rows.audit_id.is_unique
    assert (rows.provenance == "natural").sum() == 20
    assert not rows.duplicated(["model_id", "instance_id"]).any()
    again = ALL["audit_greedy"](spark, DATA).toPandas()
    assert rows.equals(again)
