"""Small builders for hand-written test rows."""

import datetime as dt
from decimal import Decimal

from cardflow.schemas import REQUEST

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def requests_df(spark, rows):
    """rows: (request_id, seconds, merchant, pan, amount_text, currency, key)."""
    data = [(rid, at(s), m, p, a, c, k) for rid, s, m, p, a, c, k in rows]
    return spark.createDataFrame(data, REQUEST)


def req(rid, s, amount="4.50", key="k1", merchant="merchant-7",
        pan="4111111111111234", currency="USD"):
    return (rid, s, merchant, pan, amount, currency, key)


D = Decimal
