import __spark_entry__ as entry


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
