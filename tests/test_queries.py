import pytest

from quirelake.plans import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lang", "span_type", "n_spans", "n_chars"]
    assert set(e.oracle_sql()) <= set(e.queries())
