"""Fraud scoring and high-risk alerts.

All Column expressions: the default rule compiles into the scan's
whole-stage codegen.  A model can be plugged in as ``score_fn``; a
vectorised pandas UDF is the right shape for that (see
``pandas_score_fn``), never a per-row Python UDF.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import ALERT_ABOVE, ALERT_SUBJECT
from cardflow.functions.scoring import alert_message, default_score, severity


def score(df: DataFrame, score_fn: Callable[[DataFrame], Column] | None = None,
          alert_above: float = ALERT_ABOVE) -> DataFrame:
    """Add riskScore and alerted (score strictly above ``alert_above``)."""
    s = score_fn(df) if score_fn is not None else default_score(F.col("amount"))
    return df.withColumn("riskScore", s).withColumn("alerted", F.col("riskScore") > alert_above)


def pandas_score_fn(model_predict: Callable, input_cols: list[str]):
    """Wrap a vectorised ``predict(pandas.DataFrame) -> array`` as a
    ``score_fn``; the input columns travel as one struct, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def _predict(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(model_predict(frame[input_cols]), dtype="float64")

    return lambda df: _predict(F.struct(*[F.col(c) for c in input_cols]))


def fraud_alerts(scored: DataFrame, escaped: bool = False) -> DataFrame:
    """One alert per alerted row: subject, severity and message body."""
    a = scored.where(F.col("alerted"))
    return a.select(
        "transactionId", "merchantId", "maskedPan", "amount", "riskScore",
        F.lit(ALERT_SUBJECT).alias("subject"),
        severity(F.col("riskScore")).alias("severity"),
        alert_message(F.col("transactionId"), F.col("merchantId"), F.col("maskedPan"),
                      F.col("amount"), F.col("riskScore"), escaped=escaped).alias("message"),
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))
