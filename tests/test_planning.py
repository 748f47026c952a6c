import datetime as dt

from cardflow.operators import planning as PL


def test_capacity_defaults(spark):
    conc = spark.createDataFrame([(dt.datetime(2024, 1, 1), 5000 * 0.2)], "bucket timestamp_ntz, concurrency double")
    rows = {r.model_rank: r for r in PL.instances(conc).collect()}
    assert (rows[0].capacity, rows[0].raw, rows[0].with_buffer) == (50, 20, 25)
    assert (rows[1].capacity, rows[1].raw, rows[1].with_buffer) == (512, 2, 3)
    assert rows[1].reduction_pct == 88 and rows[1].ratio == 8.3
    assert rows[2].with_buffer == 3


def test_storage_and_cost_defaults(spark):
    daily = spark.createDataFrame([("all", 50000.0, 2.0)], "merchantId string, daily_items double, item_kb double")
    p = PL.storage_projection(daily).first()
    assert round(p.total_items) == 201969085
    assert round(p.raw_gb, 2) == 385.23 and round(p.total_gb, 2) == 770.45
    assert p.total_label == "770.45 GB"
    costs = {r.tier: r for r in PL.tier_costs(PL.storage_projection(daily)).collect()}
    assert round(costs["hot"].monthly_cost, 2) == 192.61
    assert round(costs["warm"].monthly_cost, 2) == 17.72
    assert round(costs["cold"].monthly_cost, 2) == 0.76
    assert costs["warm"].saving_pct == 91 and costs["hot"].saving_pct is None
    assert costs["hot"].cost_label == "$192.61"


def test_format_gb(spark):
    df = spark.createDataFrame([(10.0,), (2048.0,), (3.0 * 1024 * 1024,)], "g double")
    assert [r[0] for r in df.select(PL.format_gb(df.g)).collect()] == ["10.00 GB", "2.00 TB", "3.00 PB"]


def test_concurrency_littles_law(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, i), dt.datetime(2024, 1, 1, 1, i)) for i in range(36)]
    df = spark.createDataFrame(rows, "arrival timestamp_ntz, scored_at timestamp_ntz")
    c = PL.concurrency(df, "1 hour").first()
    assert c.arrivals == 36 and c.latency_ms == 3600000.0
    assert abs(c.concurrency - 36 / 3600 * 3600) < 1e-9
