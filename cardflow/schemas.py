"""Explicit schemas.  Nothing is ever inferred."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)
# Epoch seconds with nanoseconds, as the JSON wire format writes createdAt.
EPOCH = T.DecimalType(20, 9)

# Authorization request as received: every field is text.
REQUEST = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("arrival", T.TimestampNTZType(), True),
    T.StructField("merchantId", T.StringType(), True),
    T.StructField("pan", T.StringType(), True),
    T.StructField("amount", T.StringType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("idempotencyKey", T.StringType(), True),
])

# Stored transaction (one row per idempotency key).
TRANSACTION = T.StructType([
    T.StructField("idempotencyKey", T.StringType(), False),
    T.StructField("transactionId", T.StringType(), True),
    T.StructField("merchantId", T.StringType(), True),
    T.StructField("maskedPan", T.StringType(), True),
    T.StructField("encryptedPan", T.StringType(), True),
    T.StructField("amount", AMOUNT, True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("createdAt", T.TimestampNTZType(), True),
])

TRANSACTION_COLUMNS = [f.name for f in TRANSACTION.fields]

# The same record on the wire: createdAt is a decimal epoch-seconds number.
TRANSACTION_JSON = T.StructType([
    f if f.name != "createdAt" else T.StructField("createdAt", EPOCH, True)
    for f in TRANSACTION.fields
])

# Fraud-check queue message.
FRAUD_MESSAGE = T.StructType([
    T.StructField("body", T.StringType(), True),
    T.StructField("amount", AMOUNT, True),
])

# Transaction topic record (key = masked card number).
TOPIC_RECORD = T.StructType([
    T.StructField("key", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("source_partition", T.IntegerType(), True),
    T.StructField("arrival", T.LongType(), True),
])

SCORE = T.StructType([
    T.StructField("transactionId", T.StringType(), False),
    T.StructField("riskScore", T.DoubleType(), True),
    T.StructField("alerted", T.BooleanType(), True),
    T.StructField("scored_at", T.TimestampNTZType(), True),
])

STATUS_EVENT = T.StructType([
    T.StructField("idempotencyKey", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("source", T.StringType(), True),
])

RELEASE_REQUEST = T.StructType([
    T.StructField("transactionId", T.StringType(), False),
    T.StructField("released_at", T.TimestampNTZType(), True),
])

# Tables written by the sinks, read back with their partition columns typed
# (no inference: a numeric-looking batch id stays text).
LEDGER_TABLE = T.StructType(TRANSACTION.fields + [
    T.StructField("key_bucket", T.IntegerType(), True),
    T.StructField("batch_id", T.StringType(), True),
])

STATUS_EVENT_TABLE = T.StructType(STATUS_EVENT.fields + [
    T.StructField("batch_id", T.StringType(), True),
])
