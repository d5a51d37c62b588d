"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import (ann, divergence, fingerprints, langid, lexical, mixing, packing, pii, quality, sentence_pieces, sharding, simhash_dedup,
               substring_dedup)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, fn: Callable[..., DataFrame], *sources: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(*[table(spark, sf_dir, s) for s in sources or ("documents",)])
    run.__name__, run.__doc__ = name, fn.__doc__
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


_register("op1_sharding", sharding.op1_sharding)
_register("op5_mixing", mixing.op5_mixing, sql=mixing.OP5_SQL)
_register("op4_langid", langid.op4_langid)
_register("op9_pii", pii.op9_pii)
_register("op8_packing", packing.op8_packing)
_register("op3_simhash_dedup", simhash_dedup.op3_simhash_dedup)
_register("op2_quality", quality.score, "documents", "labels")
_register("op10_ann", ann.op10_ann, "embeddings")
_register("op7_substring_dedup", substring_dedup.op7_substring_dedup)
_register("op6_fingerprints", fingerprints.op6_fingerprints)
_register("op11_lexical", lexical.op11_lexical, "documents", "benchmark", sql=lexical.OP11_SQL)
_register("op12_divergence", divergence.op12_divergence, sql=divergence.OP12_SQL)
_register("op13_sentence_pieces", sentence_pieces.op13_sentence_pieces)
