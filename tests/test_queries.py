"""Every query with oracle SQL agrees with it; the flagship has rows."""

import pytest
from conftest import SF, normal

from tidemark.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    ours = normal(registry.queries()[name](spark, SF).toPandas())
    theirs = normal(duck.execute(SQL[name]).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b] == []


def test_entry_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


@pytest.mark.parametrize(("name", "least"), [("meta_label_quality", 1), ("meta_label_trees", 0), ("behaviour_clusters", 1)])
def test_queries_without_sql_run(spark, name, least):
    assert registry.queries()[name](spark, SF).count() >= least
