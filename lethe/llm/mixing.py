"""Mixing sources to target weights.

Tokens are summed per source, the sums give each source a repetition rate, and
each document is emitted floor(rate) times plus one more copy when a number in
[0, 1) seeded by a hash of its doc_id lies below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, attach_small, framed, materialize, pick, restored, sums_before

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_RATE = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(doc_id: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the doc_id and the seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{SEED}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Per source (src_null, src): its size, target and rate.

    Targets share the sum of all sizes by weight.  A target stops at ``max_rate``
    times its source's size and the excess is shared again by weight: with the
    sources sorted by cap over weight, those before some point stand at their
    caps and the others get one common multiple of their weights: the largest level
    that some source's cap allows (treating more sources as capped lowers it).  ``sizes`` has
    (src_null, src, size); sources are numbered and added up by ranges, never all in one task.
    """
    s = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    s, _ = sums_before(s, ["src_null", "src"], {"place": F.lit(1).cast("long")})
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("w", F.element_at(pattern, (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_rate).cast("double"))
    s, whole = sums_before(s, [F.col("cap") / F.col("w"), "src_null", "src"],
                           {"size_before": F.col("source_size"), "cap_before": F.col("cap"), "w_before": F.col("w")})
    s = s.withColumn("level", (F.lit(whole["size_before"]).cast("long") - F.col("cap_before"))
                     / (F.lit(whole["w_before"]).cast("double") - F.col("w_before")))
    common = s.agg(F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))).first()[0]
    s = s.withColumn("common", F.lit(common).cast("double"))
    target = F.coalesce(F.least(F.col("cap"), F.col("common") * F.col("w")), F.col("cap"))
    s = s.withColumn("target", target)
    return s.select("src_null", "src", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def copies(rate: Column, doc_id: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(unit(doc_id) < rate - whole, 1).otherwise(0)).cast("long")


def with_source_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("src_null", F.col("source").isNull()).withColumn("src", F.coalesce("source", F.lit("")))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for every row of ``docs``.

    A null text has size 0, a null source is a source of its own (last), rows of a
    repeated doc_id get the same number of copies, and sources without a word have
    rate 0.  An empty table gives an empty result; other columns are left aside.
    """
    d = materialize(with_source_key(pick(docs, "doc_id", "text", "source").select(
        "doc_id", "source", words(F.col("text")).alias("size"))).drop("source"), "mix-sizes")
    r = materialize(rates(d, weights, max_rate), "mix-rates")
    return attach_small(d, r, ["src_null", "src"], ["doc_id"]).withColumn(
        "copies", copies(F.col("rate"), F.col("doc_id"))).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``docs`` with every row emitted as often as the mix takes it (columns unchanged).

    Texts are not moved unless the table of sources is too large to broadcast.  Null and
    empty texts have no words and are taken as often as their source's others; in a source
    without a word nothing is taken; an empty table stays empty.
    """
    sized = with_source_key(pick(docs, "source", "text").select("source", words(F.col("text")).alias("size")))
    r = materialize(rates(sized.drop("source"), weights, max_rate), "mix-rates").select("src_null", "src", "rate")
    keyed = with_source_key(framed(docs, "doc_id", "source"))
    out = attach_small(keyed, r, ["src_null", "src"], ["doc_id"])
    times = copies(F.col("rate"), F.col("doc_id")).cast("int")
    return restored(out.withColumn("copy", F.explode(F.array_repeat(F.lit(True), times))), docs)


def op5_mixing(docs: DataFrame) -> DataFrame:
    """Size, target and words taken of every row of ``documents``; ``taken`` says what nulls and empty sources give."""
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS src_null, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT src_null, src, CAST(sum(size) AS BIGINT) AS source_size,
         (ARRAY[5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY src_null, src) - 1) % 3]::DOUBLE AS w FROM d GROUP BY 1, 2),
s1 AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
         - coalesce(sum(cap) OVER (ORDER BY cap / w, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, src_null, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER () AS common FROM s2),
s4 AS (SELECT src_null, src, source_size, coalesce(least(cap, common * w), cap) AS target FROM s3),
j AS (SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 13) AS BIGINT)::DOUBLE
           / 4503599627370496.0 AS u
       FROM d JOIN s4 USING (src_null, src)),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM j)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
