"""Fraud score and alert column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow.constants import (
    ALERT_TEMPLATE, CRITICAL_ABOVE, HIGH_RISK_SCORE, HIGH_VALUE_THRESHOLD,
    LOW_RISK_SCORE, SEVERITY_CRITICAL, SEVERITY_WARNING,
)


def default_score(amount: Column, threshold=HIGH_VALUE_THRESHOLD) -> Column:
    """High score for amounts strictly above the threshold."""
    return (F.when(amount > F.lit(threshold), F.lit(HIGH_RISK_SCORE))
            .otherwise(F.lit(LOW_RISK_SCORE)))


def severity(score: Column) -> Column:
    """CRITICAL above 0.85, else WARNING."""
    return F.when(score > CRITICAL_ABOVE, F.lit(SEVERITY_CRITICAL)).otherwise(F.lit(SEVERITY_WARNING))


def alert_message(transaction_id: Column, merchant: Column, masked: Column,
                  amount: Column, score: Column, escaped: bool = False) -> Column:
    """Alert body (P10).

    The default reproduces the fixed template: values are inserted as
    they are, the amount unquoted, the score with two decimals.
    ``escaped=True`` builds real JSON instead, safe for any text.
    """
    if escaped:
        return F.to_json(F.struct(
            transaction_id.alias("transactionId"), merchant.alias("merchantId"),
            masked.alias("maskedPan"), amount.alias("amount"),
            F.round(score, 2).alias("riskScore")))
    return F.format_string(ALERT_TEMPLATE, transaction_id, merchant, masked,
                           amount.cast("string"), score)
