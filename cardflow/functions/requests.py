"""Request validation and parsing column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow.constants import (
    FORM_AMOUNT_PATTERN, FORM_CURRENCIES, FORM_MAX_PAN_LENGTH, LABEL_AMOUNT,
    LABEL_CURRENCY, LABEL_MERCHANT, LABEL_PAN, MIN_PAN_LENGTH, VALIDATION_PREFIX,
)
from cardflow.schemas import AMOUNT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters that count as blank on the server (control
# white space, the information separators, and every Unicode separator but
# the non-breaking spaces), and those that a card number loses in the form
# (which include the non-breaking ones and the byte-order mark).
BLANKS = ("\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2008\u2009\u200a\u2028\u2029\u205f\u3000")
FORM_SPACES = ("\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000\ufeff")
# Wide enough that no amount of cents is rounded on the way to the check.
EXACT = "decimal(38,18)"


def is_blank(c) -> Column:
    """NULL, empty, or whitespace only (tabs and newlines included).

    ``ltrim`` with an explicit character set, not a regular expression:
    it stays inside whole-stage codegen and stops at the first character
    that is no blank.
    """
    c = _c(c)
    return c.isNull() | (F.ltrim(c, F.lit(BLANKS)) == "")


def _checks(merchant, pan, amount, currency, strict: bool) -> list[tuple[str, Column]]:
    """(label, failed) per field, in reporting order."""
    m, p, a, cur = _c(merchant), _c(pan), _c(amount), _c(currency)
    pan_bad = is_blank(p) | (F.length(p) < MIN_PAN_LENGTH)
    amount_bad = is_blank(a)
    currency_bad = is_blank(cur)
    if strict:
        pan_bad = pan_bad | (F.length(p) > FORM_MAX_PAN_LENGTH)
        amount_bad = amount_bad | ~F.coalesce(a.rlike(FORM_AMOUNT_PATTERN), F.lit(False))
        currency_bad = currency_bad | ~F.coalesce(cur.isin(*FORM_CURRENCIES), F.lit(False))
    return [(LABEL_MERCHANT, is_blank(m)), (LABEL_PAN, pan_bad),
            (LABEL_AMOUNT, amount_bad), (LABEL_CURRENCY, currency_bad)]


def validation_labels(merchant="merchantId", pan="pan", amount="amount",
                      currency="currency", strict: bool = False) -> Column:
    """Array of the failed field labels, in reporting order (P5).

    Only the card number's length is checked, not its digits.  ``strict``
    adds the form-only rules: card at most 19 characters, amount with at
    most two decimals, currency from the form's list.
    """
    checks = _checks(merchant, pan, amount, currency, strict)
    return F.array_compact(F.array(*[F.when(bad, F.lit(label)) for label, bad in checks]))


def fields_ok(merchant="merchantId", pan="pan", amount="amount",
              currency="currency", strict: bool = False) -> Column:
    """True when no field fails: the same rules as the labels, as one
    boolean (no array is built)."""
    checks = _checks(merchant, pan, amount, currency, strict)
    bad = checks[0][1]
    for _, b in checks[1:]:
        bad = bad | b
    return ~bad


def validation_message(labels: Column) -> Column:
    """``Missing/invalid fields: a, b``; NULL when nothing failed."""
    return F.when(F.size(labels) > 0,
                  F.concat(F.lit(VALIDATION_PREFIX), F.array_join(labels, ", ")))


def parse_amount(text) -> Column:
    """Text to DECIMAL(18,2); NULL when it is not an amount.

    A decimal parse accepts signs and exponents (``1e3`` is 1000.00) but
    not surrounding whitespace.  An amount is never rounded: text with more
    than two significant decimals (2500.004) or beyond the type is NULL, so
    what is scored is what was sent.
    """
    t = _c(text)
    amount = t.try_cast(AMOUNT)
    bare = ~is_blank(F.substring(t, 1, 1)) & ~is_blank(F.substring(t, -1, 1))
    return F.when(bare & (amount == t.try_cast(EXACT)), amount)


def generated_key(request_id) -> Column:
    """Deterministic stand-in for a random key, unique per request."""
    return F.concat(F.lit("gen-"), F.sha2(_c(request_id).cast("string"), 256))


def default_key(key, request_id) -> Column:
    """Keep a supplied idempotency key; generate one when blank."""
    return F.when(~is_blank(key), _c(key)).otherwise(generated_key(request_id))


def transaction_id(key) -> Column:
    """UUID-shaped id derived from the idempotency key.

    Derived rather than random so that a retried task cannot change it;
    every attempt on one key carries the same candidate id, and only the
    winner's is stored.
    """
    h = F.sha2(_c(key), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.substring(h, 13, 4), F.substring(h, 17, 4),
                       F.substring(h, 21, 12))
