import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cardflow.functions import display as D
from cardflow.functions.pan import decrypt_pan, encrypt_pan, mask_pan, strip_spaces
from cardflow.functions.requests import (
    default_key, is_blank, parse_amount, transaction_id, validation_labels, validation_message,
)
from cardflow.functions.scoring import alert_message, default_score, severity
from cardflow.functions.text import (
    batch_id, decode_json, encode_json, epoch_to_ts, receipt_key, settlement_message, ts_to_epoch,
)


def one(spark, col, data=None, schema="x string"):
    df = spark.createDataFrame(data or [(None,)], schema)
    return [r[0] for r in df.select(col).collect()]


def test_mask_and_strip(spark):
    df = spark.createDataFrame([("4111111111111234",), ("123",), ("4111 1111\t1111 1234",), (None,)], "pan string")
    out = df.select(mask_pan("pan").alias("m"), strip_spaces("pan").alias("s")).collect()
    assert out[0].m == "**** **** **** 1234"
    assert out[1].m is None
    assert out[2].s == "4111111111111234"
    assert out[3].m is None


def test_validation_message_order(spark):
    df = spark.createDataFrame([("  ", "41111111111", None, "USD"), ("m", "411111111111", "1", "EUR"),
                                ("m", "4" * 20, "1.234", "JPY")],
                               "merchantId string, pan string, amount string, currency string")
    msgs = [r[0] for r in df.select(validation_message(validation_labels())).collect()]
    assert msgs[0] == "Missing/invalid fields: merchantId, pan (12+ digits), amount"
    assert msgs[1] is None
    assert msgs[2] is None
    strict = [r[0] for r in df.select(validation_message(validation_labels(strict=True))).collect()]
    assert strict[2] == "Missing/invalid fields: pan (12+ digits), amount, currency"


def test_blank_includes_tabs(spark):
    assert one(spark, is_blank("x"), [(" \t\n",), ("a",), (None,), ("",)]) == [True, False, True, True]
    # Unicode separators are blank, non-breaking spaces are not
    assert one(spark, is_blank("x"), [("\u3000\u2003\u2028",), ("\u00a0",), ("\u202f",)]) == [True, False, False]
    assert one(spark, strip_spaces("x"), [("4111\u00a01111\u30001\ufeff",), ("\u001c1",)]) == ["411111111", "\u001c1"]


def test_parse_amount(spark):
    got = one(spark, parse_amount("x"), [("abc",), ("1e3",), ("1.005",), ("4.50",), (" 4.50",), ("",), ("2500.004",),
                                           ("2500.005",), ("2500.000",), ("12345678901234567.00",), ("-0.10",)])
    # never rounded: what does not fit exactly is no amount
    assert got == [None, Decimal("1000.00"), None, Decimal("4.50"), None, None, None, None, Decimal("2500.00"),
                   None, Decimal("-0.10")]


def test_default_key_and_transaction_id(spark):
    df = spark.createDataFrame([(1, "k1"), (2, " "), (3, None)], "rid long, k string")
    keys = [r[0] for r in df.select(default_key("k", "rid")).collect()]
    assert keys[0] == "k1" and keys[1].startswith("gen-") and keys[1] != keys[2]
    tid = df.select(transaction_id(F.lit("k1"))).first()[0]
    assert len(tid) == 36 and tid.count("-") == 4


def test_score_edges(spark):
    got = one(spark, default_score(F.col("x").cast("decimal(18,2)")),
              [("2500.00",), ("2500.01",), ("4999.00",), ("4.50",)])
    assert got == [0.15, 0.92, 0.92, 0.15]
    assert one(spark, severity(F.col("x").cast("double")), [("0.92",), ("0.80",)]) == ["CRITICAL", "WARNING"]


def test_alert_message_template(spark):
    df = spark.createDataFrame([("t1", "m1", "**** **** **** 1234", Decimal("4999.00"), 0.92)],
                               "t string, m string, p string, a decimal(18,2), s double")
    msg = df.select(alert_message(F.col("t"), F.col("m"), F.col("p"), F.col("a"), F.col("s"))).first()[0]
    assert msg == ('{"transactionId":"t1","merchantId":"m1","maskedPan":"**** **** **** 1234",'
                   '"amount":4999.00,"riskScore":0.92}')


def test_keys_and_notices(spark):
    df = spark.createDataFrame([("m1", "t1", 0, Decimal("0")), ("m2", "t2", 2, Decimal("15.00"))],
                               "m string, t string, n long, total decimal(38,2)")
    out = df.select(receipt_key("m", "t").alias("k"), settlement_message("n", "total").alias("msg")).collect()
    assert out[0].k == "receipts/m1/t1.json"
    assert out[0].msg == "Settled 0 transaction(s) totaling 0"
    assert out[1].msg == "Settled 2 transaction(s) totaling 15.00"
    b = batch_id(dt.datetime(2024, 1, 16), "first")
    assert b.startswith("batch-1705363200000-") and len(b.split("-")[-1]) == 8


def test_epoch_round_trip(spark):
    ts = dt.datetime(2024, 1, 1, 0, 0, 7, 179575)
    df = spark.createDataFrame([(ts,)], "t timestamp_ntz")
    e = df.select(ts_to_epoch("t").alias("e")).first().e
    assert str(e) == "1704067207.179575000"
    back = df.select(epoch_to_ts(ts_to_epoch("t"))).first()[0]
    assert back == ts


def test_json_encode_decode(spark):
    row = ("k1", "t1", "m", "**** **** **** 1234", None, Decimal("4.50"), "USD", "AUTHORIZED",
           dt.datetime(2024, 1, 1, 0, 0, 7, 179575))
    from cardflow.schemas import TRANSACTION
    df = spark.createDataFrame([row], TRANSACTION)
    body = df.select(encode_json().alias("b")).first().b
    assert '"encryptedPan":null' in body and '"amount":4.50' in body
    assert body.endswith('"createdAt":1704067207.179575000}')
    back = df.select(decode_json(encode_json()).alias("t")).select("t.*").first()
    assert tuple(back) == row


def test_pan_encrypt_round_trip(spark):
    key = F.lit("0123456789abcdef0123456789abcdef")
    df = spark.createDataFrame([("4111111111111234",), ("5500000000000004",)], "pan string")
    enc = df.select("pan", encrypt_pan("pan", key).alias("c"))
    out = enc.select((decrypt_pan("c", key) == F.col("pan")).alias("ok"),
                     decrypt_pan("c", key, context="purpose=other", lenient=True).alias("bad")).collect()
    assert all(r.ok for r in out) and all(r.bad is None for r in out)
    assert one(spark, encrypt_pan(F.col("x"), None), [("4111",)]) == [None]


def test_display_columns(spark):
    df = spark.createDataFrame([(0.92, "ALERTED", "HELD_FOR_REVIEW", "receipts/m/t.json"),
                                (None, "QUEUED", "AUTHORIZED", None),
                                (0.15, "RECORDED", "DUPLICATE", "")],
                               "s double, stage string, status string, k string")
    out = df.select(D.risk_percent("s").alias("p"), D.risk_label("s").alias("l"),
                    D.stage_rank("stage").alias("r"), D.row_class("status", "stage").alias("c"),
                    D.can_release("stage").alias("rel"), D.receipt_name("k").alias("n"),
                    D.empty_if_null("k").alias("e")).collect()
    assert (out[0].p, out[0].l, out[0].r, out[0].c, out[0].rel, out[0].n) == \
        (92, "92%", 3, "status-alerted", True, "t.json")
    assert (out[1].l, out[1].r, out[1].c, out[1].n, out[1].e) == ("pending…", 1, "status-approved", None, "")
    assert out[2].c == "status-duplicate" and out[2].n is None


def test_key_is_redacted_in_plans(spark):
    import io
    import contextlib
    import pytest
    from cardflow.session import PAN_KEY_CONF, pan_key
    spark.conf.unset(PAN_KEY_CONF)
    with pytest.raises(RuntimeError, match="panKey"):  # no published fallback
        pan_key(spark)
    secret = "a-test-key-of-32-bytes-in-length"
    spark.conf.set(PAN_KEY_CONF, secret)
    try:
        key = pan_key(spark)
    finally:
        spark.conf.unset(PAN_KEY_CONF)
    df = spark.createDataFrame([("4111111111111234",)], "pan string").select(
        encrypt_pan("pan", key).alias("c"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(True)
    assert secret not in buf.getvalue()
    assert "redacted" in buf.getvalue()
