"""Per-key selection and membership operators, written to survive skew.

* ``latest_per_key`` keeps *every* row that carries the key's maximum (ties
  kept), via a partial/final aggregate and a salted join rather than a window:
  a hot key is pre-aggregated map-side and its rows meet their maximum in many
  tasks, while a window would sort the whole hot group inside one.
* ``pick_one_per_key`` keeps exactly one row per key (newest first, then a
  deterministic tie-break) with ``max_by`` over a struct: one aggregate.
* ``not_in`` is SQL ``x NOT IN (subquery)`` with its NULL rules, as a hash
  anti-join plus two scalar subqueries, so it is not tied to the
  broadcast-only null-aware anti-join.
* ``broadcast_if_small`` broadcasts a side only after measuring its rows and
  bytes; beyond the bounds the join is left to the shuffle planner / AQE.
* ``place_in_order`` numbers rows in a global order by range-sorted partitions
  and the count of the rows before each, while a window without a partition key
  would sort all rows inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Largest table we broadcast on our own initiative: rows and measured bytes.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Whether ``df`` holds at most ``max_rows`` rows and BROADCAST_MAX_BYTES
    bytes, by one aggregate (combined map-side).  The answer is remembered on
    the DataFrame object, so a subject set shared by many joins is measured
    once."""
    memo = getattr(df, "_lethe_small", None)
    if memo is not None and memo[0] == max_rows:
        return memo[1]
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16
                 for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))), F.lit(16))
    n, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    small = n <= max_rows and (size or 0) <= BROADCAST_MAX_BYTES
    try:
        df._lethe_small = (max_rows, small)
    except AttributeError:
        pass
    return small


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when it holds at most ``max_rows`` rows, else ``df``."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def latest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Rows of ``df`` whose ``order_col`` equals the maximum for their ``key``.

    Ties are kept (the correlated ``col = (SELECT MAX(col) ... )`` pattern).
    Rows with a NULL key or NULL ``order_col`` never match, as in SQL.
    """
    mx = (df.where(F.col(key).isNotNull())
            .groupBy(key).agg(F.max(order_col).alias("__max")))
    from .skew import salted_join
    mx = mx.withColumnRenamed(key, "__key")
    return (salted_join(df, mx, key, "__key", "inner")
            .where(F.col(order_col) >= F.col("__max"))
            .drop("__max", "__key"))


def pick_one_per_key(df: DataFrame, key: str, order_cols: list[str],
                     value_cols: list[str]) -> DataFrame:
    """One row per ``key``: the greatest ``order_cols`` tuple (ORDER BY ...
    DESC LIMIT 1 per key, with the later columns breaking ties)."""
    order = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in value_cols])
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.max_by(payload, order).alias("__row"))
              .select(key, *[F.col(f"__row.{c}").alias(c) for c in value_cols]))


def not_in(df: DataFrame, col: str, subset: DataFrame, subset_col: str,
           max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df WHERE col NOT IN (SELECT subset_col FROM subset)`` with SQL NULLs.

    An empty subset keeps every row (NULLs too); otherwise a NULL ``col`` is
    dropped, and a NULL inside the subset drops everything.
    """
    keys = subset.select(F.col(subset_col).alias("__k")).where(F.col("__k").isNotNull())
    # one scalar subquery: (set non-empty?, set holds a NULL?)
    flags = subset.agg(F.struct(
        (F.count(F.lit(1)) > 0).alias("nonempty"),
        F.coalesce(F.max(F.col(subset_col).isNull()), F.lit(False)).alias("has_null")
    ).alias("f")).scalar()
    nonempty, has_null = flags.getField("nonempty"), flags.getField("has_null")
    if is_small(keys, max_rows):
        kept = df.join(F.broadcast(keys), df[col] == F.col("__k"), "left_anti")
    else:
        # NULL probe keys never match: they get a spread, non-matching key;
        # hot keys are salted over several tasks
        from .skew import salted_join
        kept = salted_join(df, keys.distinct(), col, "__k", "left_anti")
    return kept.where(~(nonempty & (F.col(col).isNull() | has_null)))


NULL_KEY_PREFIX = "\u0000null:"


def spread_nulls(df: DataFrame, col: str) -> Column:
    """``col``, or for NULLs a per-row key that matches nothing (a hash of
    the row behind a prefix no real key has): shuffle joins then spread NULL
    rows over all partitions instead of one."""
    return F.when(F.col(col).isNull(),
                  F.concat(F.lit(NULL_KEY_PREFIX), F.xxhash64(*[F.col(c) for c in df.columns])
                           .cast("string"))).otherwise(F.col(col).cast("string"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def place_in_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` plus ``out``: a gapless number from 1 in ``order``.

    Rows are sorted by ranges and written once with their partition and their
    number in it, both from ``monotonically_increasing_id`` (33 bits of
    number); the driver sees one count per partition.
    """
    spark = df.sparkSession
    held = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    held = held.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    starts, before = [], 0
    for part, n in sorted(held.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        starts.append((part, before))
        before += n
    table = spark.createDataFrame(starts, "_part long, _before long")  # one row per partition
    return (held.join(F.broadcast(table), "_part")
            .withColumn(out, F.col("_before") + F.col("_nth") + 1)
            .drop("_at", "_part", "_nth", "_before"))
