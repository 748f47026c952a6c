"""Fixed-width sort keys and codes for hash-aggregatable folds.

``max_by``/``min_by`` over a struct or a string keep a variable-width
buffer, which forces sort-based aggregation.  Packing the ordering into one
number and the value into a small code keeps every buffer fixed-width, so
the aggregation is a hash aggregation with map-side partial results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow.functions.text import epoch_micros

_D = "decimal(38,0)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dec(n: int) -> Column:
    """An exact DECIMAL(38,0) literal (built from text: may exceed a long)."""
    return F.lit(str(n)).cast(_D)


def time_seq(ts, seq) -> Column:
    """(time, small seq < 16) as one long, ordered like the pair."""
    return epoch_micros(ts) * F.lit(16) + _c(seq).cast("bigint")


def time_id(ts, id_) -> Column:
    """(time, any long id) as one DECIMAL(38,0), ordered like the pair."""
    shifted = _c(id_).cast(_D) + _dec(2 ** 63)  # 0 <= shifted < 2^64 < 10^20
    return epoch_micros(ts).cast(_D) * _dec(10 ** 20) + shifted


def time_seq_time(ts, seq, ts2) -> Column:
    """(time, seq < 16, second time) as one DECIMAL(38,0), ordered like the triple."""
    second = epoch_micros(ts2).cast(_D) + _dec(5 * 10 ** 16)  # in [0, 10^17)
    return time_seq(ts, seq).cast(_D) * _dec(10 ** 17) + second


def code_of(col, values: list[str]) -> Column:
    """1-based position of ``col`` in ``values`` (0 when absent)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), _c(col)).cast("int")


def value_of(code, values: list[str]) -> Column:
    """Inverse of :func:`code_of` (NULL for 0 or NULL)."""
    return F.when(_c(code) > 0, F.element_at(F.array(*[F.lit(v) for v in values]), _c(code)))
