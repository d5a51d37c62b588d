"""Joining big tables to a set of data subjects, skew-safely.

Every erasure-side operator asks the same two questions of a large table:
which rows belong to one of these subjects, and how many rows does each
subject have?  Two physical strategies, chosen by a row count of the subject
set (never by guesswork):

* the set is small (the usual case: one batch of requests) -> it is
  broadcast; the table is filtered or tagged map-side, no shuffle of the
  table at all;
* the set is large -> a shuffle join.  Rows whose key is NULL can never
  match; they get a spread, non-matching probe key (otherwise they would
  all hash to one task); keys with very many rows are salted over several
  tasks (``operators.skew``); counting pre-aggregates per value before the
  shuffle, so a hot value is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, build, maybe_in
from .keyed import BROADCAST_MAX_ROWS, is_small
from .skew import salted_join

SUBJECT = "customer_email"
# Subject sets up to this many keys are also pushed into the table scans as
# an IN predicate (Parquet row-group / dictionary skipping); a proven bound,
# so the literal list stays small.
PUSHDOWN_MAX_KEYS = 1000


def few_subject_keys(subjects: DataFrame, max_keys: int = PUSHDOWN_MAX_KEYS) -> list[str] | None:
    """The distinct subject keys when there are at most ``max_keys`` of
    them (counted first, bounded), else None.  Remembered on the DataFrame."""
    memo = getattr(subjects, "_lethe_keys", None)
    if memo is not None and memo[0] == max_keys:
        return memo[1]
    keys = None
    if is_small(subjects, max_keys):
        keys = sorted({r[0] for r in subjects.select(SUBJECT).where(F.col(SUBJECT).isNotNull())
                      .distinct().collect()})
    try:
        subjects._lethe_keys = (max_keys, keys)
    except AttributeError:
        pass
    return keys


def prefilter(df: DataFrame, cols: list[str], subjects: DataFrame) -> DataFrame:
    """``df`` restricted to rows where some of ``cols`` may hold a subject:
    an IN predicate the Parquet scan can use to skip row groups.  Only an
    optimisation -- the joins that follow still decide matches."""
    keys = few_subject_keys(subjects)
    if keys is None or not cols:
        return df
    if not keys:
        return df.where(F.lit(False))
    cond = F.col(cols[0]).isin(keys)
    for c in cols[1:]:
        cond = cond | F.col(c).isin(keys)
    return df.where(cond)


def subject_side(subjects: DataFrame, alias: str, max_rows: int = BROADCAST_MAX_ROWS
                 ) -> tuple[DataFrame, bool]:
    """Distinct non-NULL subject keys as column ``alias``, broadcast-hinted
    when the set holds at most ``max_rows`` rows; returns (side, small)."""
    s = (subjects.select(F.col(SUBJECT).alias(alias))
         .where(F.col(alias).isNotNull()).distinct())
    small = is_small(subjects, max_rows)
    return (F.broadcast(s) if small else s), small


def subject_bloom(subjects: DataFrame) -> Bloom | None:
    """The Bloom filter of the subject keys; remembered on the DataFrame, so a
    set shared by many tables is read once."""
    memo = getattr(subjects, "_lethe_bloom", None)
    if memo is not None:
        return memo[0]
    bloom = build(subjects, SUBJECT)
    try:
        subjects._lethe_bloom = (bloom,)
    except AttributeError:
        pass
    return bloom


def tag_rows(df: DataFrame, subjects: DataFrame, cols: list[str],
             max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` plus ``__subjects``, the distinct subjects whose keys appear in
    ``cols`` (in column order), and ``__subject``, the first of them (NULL
    when none)."""
    out = df
    hits = []
    for i, c in enumerate(cols):
        alias = f"__s{i}"
        side, small = subject_side(subjects, alias, max_rows)
        if small:
            out = out.join(side, out[c] == side[alias], "left")
        else:
            # shuffle join: NULL keys get a spread, non-matching probe key
            # and hot keys are salted over several tasks (see operators.skew)
            out = salted_join(out, side, c, alias, "left", bloom=subject_bloom(subjects))
        hits.append(F.col(alias))
    found = (F.array_distinct(F.array_compact(F.array(*hits))) if hits
             else F.array().cast("array<string>"))
    return (out.withColumn("__subjects", found).withColumn("__subject", F.get("__subjects", F.lit(0)))
            .drop(*[f"__s{i}" for i in range(len(cols))]))


def count_matches(long: DataFrame, value_col: str, subjects: DataFrame, group: list[str],
                  max_rows: int = BROADCAST_MAX_ROWS, name: str = "records_found") -> DataFrame:
    """Rows of ``long`` per (subject, ``group``) whose ``value_col`` is a
    subject key.  Output: customer_email, *group, ``name``."""
    side, small = subject_side(subjects, "__subject", max_rows)
    v = long.where(F.col(value_col).isNotNull())
    if small:
        j = v.join(side, v[value_col] == side["__subject"], "inner")
        return (j.groupBy(F.col("__subject").alias(SUBJECT), *group)
                .agg(F.count(F.lit(1)).alias(name)))
    v = maybe_in(v, value_col, subject_bloom(subjects))
    pre = v.groupBy(*group, value_col).agg(F.count(F.lit(1)).alias(name))
    j = pre.join(side, pre[value_col] == side["__subject"], "inner")
    return j.select(F.col("__subject").alias(SUBJECT), *group, name)
