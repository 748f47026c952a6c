"""Hot-key splitting for joins whose big side may hold one huge key.

A join on a key sends every row of that key to one task.  When one key
holds a third of all rows (a retry storm on one idempotency key, a card
used by a bot), that task holds a third of the data.  AQE's skew-join
split does not apply when one side of the join is an aggregate rather
than a plain shuffle, so the split is made explicit:

1. ``hot_keys``: from per-key row counts (a partial aggregation, itself
   skew-safe), every key above ``hot_rows``, with a number of splits that
   grows with its rows.  There are at most rows / ``hot_rows`` of them.  The
   table is written once, so the planner knows its size: it is broadcast
   under the session's threshold, and above it the join is a shuffle of two
   plain tables, which AQE splits.
2. ``salted_join``: big-side rows of a hot key get a salt in
   ``[0, splits)`` from a per-row hash; small-side rows of a hot key are
   copied once per salt; the join runs on (key, salt).  A hot key is then
   spread over ``splits`` tasks, and the small side grows only by the
   copies of hot keys' rows.  Non-hot keys use salt 0 and are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.session import materialize

# A key with more rows than this on the big side is split.
HOT_KEY_ROWS = 1_000_000
# Target rows per split of a hot key.
ROWS_PER_SPLIT = 500_000


def hot_keys(counts: DataFrame, key: str, n: str = "n", hot_rows: int = HOT_KEY_ROWS,
             rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Written table (key, _splits) of the keys to split."""
    splits = F.ceil(F.col(n) / F.lit(rows_per_split)).cast("int")
    return materialize(counts.where(F.col(n) > F.lit(hot_rows))
                       .select(F.col(key), F.greatest(splits, F.lit(2)).alias("_splits")), "hot-keys")


def salted_join(big: DataFrame, small: DataFrame, on: str, hot: DataFrame,
                salt_of: Column, how: str = "inner") -> DataFrame:
    """``big`` join ``small`` on ``on`` with hot keys spread over salts.

    ``hot`` comes from :func:`hot_keys`; ``salt_of`` is a deterministic
    per-row hash of the big side (e.g. of a unique id), so a retried task
    puts every row in the same split.  ``how`` is ``inner`` or ``left``
    (big side preserved).
    """
    b = (big.join(hot, on, "left")
         .withColumn("_salt", F.when(F.col("_splits").isNull(), F.lit(0))
                     .otherwise(F.pmod(salt_of, F.col("_splits"))).cast("int"))
         .drop("_splits"))
    copies = F.when(F.col("_splits").isNull(), F.array(F.lit(0))) \
        .otherwise(F.sequence(F.lit(0), F.col("_splits") - 1))
    s = small.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_splits")
    return b.join(s, [on, "_salt"], how).drop("_salt")
