"""Keys, ids, notices and the JSON wire format."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow.constants import (
    BATCH_ID_PREFIX, RECEIPT_KEY_TEMPLATE, SETTLEMENT_MESSAGE_TEMPLATE,
    SETTLEMENT_SUBJECT_PREFIX, SUMMARY_KEY_TEMPLATE,
)
from cardflow.schemas import EPOCH, TRANSACTION_COLUMNS, TRANSACTION_JSON


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def receipt_key(merchant, txn) -> Column:
    """``receipts/<merchant>/<transaction>.json``."""
    return F.format_string(RECEIPT_KEY_TEMPLATE, _c(merchant), _c(txn))


def batch_id(cutoff: _dt.datetime, salt: str) -> str:
    """``batch-<epoch ms>-<8 hex>`` for a settlement run at ``cutoff``.

    The cutoff and salt are parameters, so a rerun names the same batch.
    """
    import hashlib
    if cutoff.tzinfo is None:
        cutoff = cutoff.replace(tzinfo=_dt.timezone.utc)
    ms = int(cutoff.timestamp() * 1000)
    return f"{BATCH_ID_PREFIX}{ms}-{hashlib.sha256(salt.encode()).hexdigest()[:8]}"


def batch_id_col(cutoff: Column, salt: Column) -> Column:
    """Column form of :func:`batch_id`."""
    return F.concat(F.lit(BATCH_ID_PREFIX), F.floor(epoch_micros(cutoff) / 1000).cast("string"),
                    F.lit("-"), F.substring(F.sha2(salt, 256), 1, 8))


def summary_key(batch) -> Column:
    """``settlements/<batch>.json``."""
    return F.format_string(SUMMARY_KEY_TEMPLATE, _c(batch))


def settlement_subject(batch) -> Column:
    return F.concat(F.lit(SETTLEMENT_SUBJECT_PREFIX), _c(batch))


def plain_total(count, total) -> Column:
    """Total as exact text; an empty batch prints ``0`` (a zero with no scale)."""
    return F.when(_c(count) == 0, F.lit("0")).otherwise(_c(total).cast("string"))


def settlement_message(count, total) -> Column:
    """``Settled %d transaction(s) totaling %s`` (K7)."""
    return F.format_string(SETTLEMENT_MESSAGE_TEMPLATE, _c(count), plain_total(count, total))


def ntz_as_utc(ts) -> Column:
    """A wall-clock (TIMESTAMP_NTZ) value read as UTC, as a TIMESTAMP
    (what watermarks need), independent of the session zone."""
    return F.timestamp_micros(epoch_micros(ts))


def utc_as_ntz(ts) -> Column:
    """A TIMESTAMP as its UTC wall clock (TIMESTAMP_NTZ)."""
    return from_epoch_micros(F.unix_micros(_c(ts)))


def ntz_lit(value) -> Column:
    """A wall-clock literal (TIMESTAMP_NTZ) from a datetime, date or text.

    Built from text: a Python datetime handed to ``lit`` becomes a
    zone-aware TIMESTAMP, and casting that to NTZ would shift it by the
    session's zone.
    """
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def _epoch_ntz() -> Column:
    return ntz_lit("1970-01-01 00:00:00")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (TIMESTAMP_NTZ) value.

    ``timestampdiff`` on NTZ values involves no time zone, unlike a cast
    to TIMESTAMP, which reads the wall clock in the session's zone.
    """
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), _c(ts).cast("timestamp_ntz"))


def from_epoch_micros(us) -> Column:
    """Inverse of :func:`epoch_micros`, a TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", _c(us), _epoch_ntz())


def ts_to_epoch(ts) -> Column:
    """Timestamp to decimal epoch seconds with nine decimals (wire format)."""
    return (epoch_micros(ts).cast("decimal(20,0)") / F.lit(1000000)).cast(EPOCH)


def epoch_to_ts(epoch) -> Column:
    """Decimal epoch seconds back to a timestamp, truncated to microseconds.

    Reading the number as DECIMAL(20,9) first avoids both traps: a JSON
    number read straight into a timestamp is NULL, and timestamp_seconds
    on nine decimals fails with a rounding error.
    """
    e = _c(epoch).cast(EPOCH)
    return from_epoch_micros(F.floor(e * F.lit(1000000)).cast("bigint"))


def encode_json(df_cols: list[str] | None = None) -> Column:
    """A transaction row as its JSON message body.

    Nulls are written (``"encryptedPan":null``), the amount keeps its
    scale, createdAt is epoch seconds with nanoseconds.
    """
    cols = df_cols or TRANSACTION_COLUMNS
    fields = [ts_to_epoch(c).alias(c) if c == "createdAt" else F.col(c) for c in cols]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def decode_json(body) -> Column:
    """JSON message body to a transaction struct (createdAt as a timestamp).
    For one field of it; ``with_decoded`` gives all of them with one parse."""
    return _transaction(F.from_json(_c(body), TRANSACTION_JSON))


def with_decoded(df, body: str, out: str = "t"):
    """``df`` with the transaction struct of a JSON message body as ``out``.

    The parsed value goes through a generator: read field by field, the
    optimizer would narrow the parse to each field and parse every body once
    per field.
    """
    parsed = df.withColumn("_json", F.explode(F.array(F.from_json(_c(body), TRANSACTION_JSON))))
    return parsed.withColumn(out, _transaction(F.col("_json"))).drop("_json")


def _transaction(parsed: Column) -> Column:
    return F.struct(*[
        epoch_to_ts(parsed.getField(f.name)).alias(f.name) if f.name == "createdAt"
        else parsed.getField(f.name).alias(f.name)
        for f in TRANSACTION_JSON.fields
    ])


def iso_instant(ntz) -> Column:
    """A wall-clock UTC value as an ISO-8601 instant, seconds precision when
    the fraction is zero (``2024-01-01T00:00:30Z``)."""
    wall = _c(ntz).cast("timestamp_ntz")
    whole = F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.regexp_replace(F.date_format(wall, "SSSSSS"), "0+$", "")
    return F.concat(whole, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                    F.lit("Z"))
