"""Every catalogue query against the SQL that states its result."""

import pytest

from crawlframe.plans import catalog
from tests.helpers import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    assert_same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


def test_entry_without_training_data_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
