"""Card-number column functions: strip, mask, encrypt, decrypt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow.constants import ENCRYPTION_CONTEXT, MASK_PREFIX


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_spaces(pan) -> Column:
    """Remove every white-space character of the form's set from a card
    number, the non-breaking ones included (P4).

    ``translate`` deletes the characters outright (no regular expression).
    """
    from cardflow.functions.requests import FORM_SPACES
    return F.translate(_c(pan), FORM_SPACES, "")


def mask_pan(pan) -> Column:
    """``**** **** **** `` + last four digits; NULL when shorter than four."""
    pan = _c(pan)
    return F.when(F.length(pan) >= 4, F.concat(F.lit(MASK_PREFIX), F.substring(pan, -4, 4)))


def encrypt_pan(pan, key: Column | None, context: str = ENCRYPTION_CONTEXT) -> Column:
    """AES-GCM ciphertext of the card number, base64; NULL when disabled.

    ``key`` is a Column (e.g. a literal read from config at run time) or
    None for the no-encryption mode, in which nothing sensitive is kept.
    The context string is bound as additional authenticated data, so a
    ciphertext only decrypts under the same context.
    """
    if key is None:
        return F.lit(None).cast("string")
    return F.base64(F.aes_encrypt(_c(pan), key, F.lit("GCM"), F.lit("DEFAULT"),
                                  F.lit(""), F.lit(context)))


def decrypt_pan(cipher_b64, key: Column | None, context: str = ENCRYPTION_CONTEXT,
                lenient: bool = False) -> Column:
    """Inverse of :func:`encrypt_pan`.

    Disabled mode (``key`` None) fails, as there is nothing to decrypt.
    ``lenient=True`` yields NULL for a wrong key or context instead of
    failing the job.
    """
    if key is None:
        raise ValueError("encryption is disabled: the card number was never stored")
    fn = F.try_aes_decrypt if lenient else F.aes_decrypt
    return fn(F.unbase64(_c(cipher_b64)), key, F.lit("GCM"), F.lit("DEFAULT"),
              F.lit(context)).cast("string")
