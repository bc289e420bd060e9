"""The Spark model views equal the SQL model views, row for row."""

import pytest

from lumenstock.plans.model_sql import VIEWS, with_model
from lumenstock.sources.catalog import Catalog
from tests.support import compare


@pytest.mark.parametrize("view", sorted(VIEWS))
def test_view_equals_sql(spark, con, sf_dir, view):
    job = lambda s, d: getattr(Catalog(s, d), view[2:])
    problem, rows, *_ = compare(spark, con, view, job, with_model(f"SELECT * FROM {view}"), sf_dir)
    assert problem == ""
    assert rows > 0
