import pytest
from compare import assert_same, connection

from weftline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    assert_same(got, connection(data).sql(catalog.ORACLES[name]).df())


def test_entry_gives_rows(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
