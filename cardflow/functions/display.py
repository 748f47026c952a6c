"""Dashboard display columns over feed rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow.constants import (
    ALERT_ABOVE, PENDING_LABEL, ROW_ALERTED, ROW_APPROVED, ROW_DUPLICATE,
    STAGE_ALERTED, STAGE_ORDER, STATUS_DUPLICATE_LABEL,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_percent(score) -> Column:
    """Score as a whole percent, half rounded up."""
    return F.round(_c(score) * 100).cast("bigint")


def risk_label(score) -> Column:
    """``92%``, or ``pending…`` before scoring."""
    return F.coalesce(F.concat(risk_percent(score).cast("string"), F.lit("%")), F.lit(PENDING_LABEL))


def risk_high(score) -> Column:
    return _c(score) > ALERT_ABOVE


def short_id(txn) -> Column:
    """First eight characters and an ellipsis."""
    return F.concat(F.substring(_c(txn), 1, 8), F.lit("…"))


def receipt_name(key) -> Column:
    """Last path segment of the receipt key; NULL when there is none."""
    k = _c(key)
    return F.when(F.coalesce(k, F.lit("")) != "", F.element_at(F.split(k, "/"), -1))


def amount_label(amount, currency) -> Column:
    return F.concat_ws(" ", _c(amount), _c(currency))


def stage_rank(stage) -> Column:
    """Zero-based position in the stage order; -1 when unknown."""
    return (F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), _c(stage)) - 1).cast("int")


def row_class(status, stage) -> Column:
    return (F.when(_c(status) == STATUS_DUPLICATE_LABEL, F.lit(ROW_DUPLICATE))
            .when(_c(stage) == STAGE_ALERTED, F.lit(ROW_ALERTED))
            .otherwise(F.lit(ROW_APPROVED)))


def can_release(stage) -> Column:
    return F.coalesce(_c(stage) == STAGE_ALERTED, F.lit(False))


def empty_if_null(c) -> Column:
    """Response default: NULL text becomes an empty string."""
    return F.coalesce(_c(c), F.lit(""))
