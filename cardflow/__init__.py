"""cardflow: card-transaction analytics as Spark DataFrame operators.

Typical batch use::

    from cardflow import build_session, read_requests, normalize_requests, authorize, new_rows
    spark = build_session()
    valid, rejected = normalize_requests(read_requests(spark, "landing/requests"))
    outcomes = authorize(valid, ledger=spark.read.parquet("ledger"), batch_id="b42")
    write_ledger(new_rows(outcomes), "ledger", "b42")

Streams use the same operators (``cardflow.streaming``).
"""

from cardflow.session import build_session, checkpoint_root
from cardflow.sources.readers import (
    decode_messages, read_fraud_queue, read_receipts, read_requests, read_topic,
)
from cardflow.operators.authorize import authorize, new_rows, normalize_requests, to_transactions
from cardflow.operators.lifecycle import (
    current_rows, current_status, find_by_key, find_by_status, hold, release, settle_events,
    status_update,
)
from cardflow.operators.scoring import fraud_alerts, pandas_score_fn, score, severity_counts
from cardflow.operators.settlement import settle, settled_ids, settlement_notice, summary, totals
from cardflow.operators.feed import apply_actions, entries, feed_display, newest_entry, recent_feed
from cardflow.operators.velocity import (
    drop_late, velocity_alerts, velocity_exact, velocity_trailing, velocity_tumbling, window_counts,
)
from cardflow.operators.planning import (
    concurrency, daily_volume, instances, storage_projection, tier_costs,
)
from cardflow.sinks.messages import fraud_messages, topic_records
from cardflow.sinks.writers import write_ledger, write_receipts, write_summary

__all__ = [
    "build_session", "checkpoint_root",
    "read_requests", "read_topic", "read_fraud_queue", "read_receipts", "decode_messages",
    "normalize_requests", "to_transactions", "authorize", "new_rows",
    "status_update", "current_status", "current_rows", "find_by_key", "find_by_status", "hold",
    "release", "settle_events",
    "score", "pandas_score_fn", "fraud_alerts", "severity_counts",
    "totals", "settled_ids", "summary", "settle", "settlement_notice",
    "entries", "apply_actions", "recent_feed", "newest_entry", "feed_display",
    "window_counts", "velocity_alerts", "velocity_tumbling", "velocity_trailing", "drop_late",
    "velocity_exact",
    "concurrency", "instances", "daily_volume", "storage_projection", "tier_costs",
    "fraud_messages", "topic_records",
    "write_ledger", "write_receipts", "write_summary",
]
