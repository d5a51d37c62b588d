"""A blocked Bloom filter of a large key set, tested before a shuffle.

A subject set too large to broadcast meets the tables in a shuffle join, which
moves every row although few belong to a subject.  The filter says map-side of
most rows that they do not: a key sets ``WORDS`` bits, one in each word of the
block its hash names.  Blocks are rows, made by one aggregate and broadcast, so
nothing passes through the driver but their count; a row is kept by a semi-join
on the block whose condition tests the bits.  A key that was put in is always
found; of others some 0.3 % pass at ``KEYS_PER_BLOCK`` keys a block and 16 % at
``MOST_KEYS_PER_BLOCK``.  Sets beyond that get no filter: the join decides alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WORDS = 4
KEYS_PER_BLOCK = 16
MOST_KEYS_PER_BLOCK = 64
#: Blocks are broadcast: at most so many, of 40 bytes each.
MAX_BLOCKS = 1 << 20


@dataclass(frozen=True)
class Bloom:
    blocks: DataFrame  # __block, __w0 .. __w3
    n_blocks: int


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")


def _bits(key: Column) -> list[Column]:
    """One bit a word, from six bits each of a second hash."""
    h = F.xxhash64(key, F.lit("bloom"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int"))
            for i in range(WORDS)]


def build(keys: DataFrame, col: str, max_blocks: int = MAX_BLOCKS) -> Bloom | None:
    """The filter of the non-NULL values of ``col`` as strings, or None where
    there are more than ``max_blocks * MOST_KEYS_PER_BLOCK``.  Repeated keys
    count as one; the filter of no keys lets nothing pass."""
    k = keys.select(F.col(col).cast("string").alias("__k")).where(F.col("__k").isNotNull()).distinct()
    k = materialize(k, "bloom-keys")
    n = k.count()
    if n > max_blocks * MOST_KEYS_PER_BLOCK:
        return None
    n_blocks = max(1, min(max_blocks, -(-n // KEYS_PER_BLOCK)))
    bits = _bits(F.col("__k"))
    blocks = (k.select(_block(F.col("__k"), n_blocks).alias("__block"), *[b.alias(f"__w{i}") for i, b in enumerate(bits)])
              .groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)]))
    return Bloom(materialize(blocks, "bloom"), n_blocks)


def maybe_in(df: DataFrame, col: str, bloom: Bloom | None) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be a key: every row whose value is one,
    and a few others.  NULL is no key.  Without a filter, ``df`` itself."""
    if bloom is None:
        return df
    key = df[col].cast("string")
    b = F.broadcast(bloom.blocks)
    cond = df[col].isNotNull() & (_block(key, bloom.n_blocks) == b["__block"])
    for i, bit in enumerate(_bits(key)):
        cond = cond & (b[f"__w{i}"].bitwiseAND(bit) != 0)
    return df.join(b, cond, "left_semi")
