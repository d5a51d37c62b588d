"""Salted shuffle joins.

When a join cannot broadcast its small side, every row of one key meets in
one reduce task; a key holding a third of a table would make that task the
whole job.  ``salted_join`` deals such keys over sub-keys:

1. the rows of each key of the big side are counted, combined map-side; the
   keys of more than ``HOT_ROWS`` rows (at most one for that many rows of the
   table) are broadcast;
2. a big-side row of a hot key gets a salt in ``[0, buckets)`` from a hash of
   the row (deterministic, so a retried task reproduces it), any other row 0;
3. small-side rows of a hot key are repeated for every salt, the others are
   not; rows meet on (key, salt).

Only a hot key's rows are repeated, so what is shuffled is each side once and
one count a key.  NULL keys never match; they get a spread, non-matching probe
key (see ``spread_nulls``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, maybe_in
from .keyed import is_small, spread_nulls

SALT_BUCKETS = 64  # sub-keys a hot key is dealt over
HOT_ROWS = 10_000  # rows of one key that one task takes


def hot_keys(big: DataFrame, key: str, hot_rows: int = HOT_ROWS, bloom: Bloom | None = None) -> DataFrame:
    """The values of ``key`` (as strings, ``__hot``) that more than ``hot_rows`` rows have."""
    k = maybe_in(big, key, bloom).select(F.col(key).cast("string").alias("__hot")).where(F.col("__hot").isNotNull())
    return k.groupBy("__hot").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select("__hot")


def salted_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, how: str,
                buckets: int = SALT_BUCKETS, broadcast_max_rows: int | None = None,
                bloom: Bloom | None = None, hot_rows: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined to ``small`` on ``big_key == small_key`` with the hot keys
    of ``big`` salted.  ``how`` is ``left``, ``inner`` or ``left_anti``;
    the output has ``big``'s columns (plus ``small``'s unless anti).

    With ``broadcast_max_rows``, a ``small`` side within that bound (counted
    first) is broadcast instead: a map-side join has no reduce task for a hot
    key to overload.  ``bloom``, a filter of ``small``'s keys, keeps rows that it
    rules out from the count and, in an inner join, from the shuffle.  ``hot``:
    the ``hot_keys``, where several joins share them."""
    cols = big.columns
    keep = cols if how == "left_anti" else cols + [c for c in small.columns if c not in cols]
    if broadcast_max_rows is not None and is_small(small, broadcast_max_rows):
        sb = F.broadcast(small)
        out = big.join(sb, big[big_key] == sb[small_key], how)
        return out.select(*[big[c] if c in cols else sb[c] for c in keep])
    probe = spread_nulls(big, big_key)
    if big.isStreaming:  # a stream's keys cannot be counted beforehand
        b = big.withColumn("__probe", probe)
        out = b.join(small, b["__probe"] == small[small_key], how)
        return out.select(*[b[c] if c in cols else small[c] for c in keep])
    hot = hot if hot is not None else hot_keys(big, big_key, hot_rows, bloom)
    if how == "inner":
        big = maybe_in(big.where(F.col(big_key).isNotNull()), big_key, bloom)
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(buckets)).cast("int")).otherwise(0)
    b = (big.withColumn("__probe", probe).join(F.broadcast(hot), F.col("__probe") == F.col("__hot"), "left")
         .withColumn("__salt", salt).drop("__hot"))
    renamed = small.select(*[F.col(c).alias(f"__small_{c}") for c in small.columns])
    salts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    s = (renamed.withColumn("__key_of", F.col(f"__small_{small_key}").cast("string"))
         .join(F.broadcast(hot), F.col("__key_of") == F.col("__hot"), "left")
         .withColumn("__salt_of", F.explode(salts)).drop("__hot"))
    out = b.join(s, (F.col("__probe") == F.col("__key_of")) & (F.col("__salt") == F.col("__salt_of")), how)
    return out.select(*[F.col(c) if c in cols else F.col(f"__small_{c}").alias(c) for c in keep])
