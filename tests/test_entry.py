import __spark_entry__
from pagechron.plans.registry import table


def test_entry_has_every_page(spark):
    assert __spark_entry__.entry(spark).count() == table(spark, __spark_entry__.SMOKE, "orders").count()
