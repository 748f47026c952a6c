"""Results must not depend on the session time zone (data are wall-clock
TIMESTAMP_NTZ values)."""

import pytest

import __spark_entry__ as E
from cardflow.plans import catalog
from cardflow.plans.context import Pipeline
from tests.conftest import SF001
from tests.oracle import rows_of

NAMES = ["velocity_trailing", "velocity_exact_late", "concurrency_by_hour", "fraud_messages",
         "message_round_trip", "velocity_tumbling", "settlement_notice"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_in_other_zone(spark, name):
    build = catalog.REGISTRY[name][0]
    base = build(spark, SF001)
    want = rows_of(base.columns, [tuple(r) for r in base.collect()])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        Pipeline._shared.clear()  # rebuild every stage from the source
        other = build(spark, SF001)
        got = rows_of(other.columns, [tuple(r) for r in other.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
        Pipeline._shared.clear()
    assert got == want
    assert E.queries()  # registry intact
