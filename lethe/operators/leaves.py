"""Leaves of semi-structured columns as rows.

A column of JSON text may hold personal data at any depth.  ``json_leaves``
walks it level by level: a level's objects and arrays give their members as the
next level's rows, all other values are leaves.  Each level is written once, so
no level is parsed or walked again, and the walk ends at the first level without
an object or array, however deep the values go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")


def json_leaves(df: DataFrame, col: str, keep: list[str] = ()) -> DataFrame:
    """One row per leaf of the JSON text ``col``: ``keep``, ``path`` and ``leaf``.

    Paths read ``$.key[*]."odd key"``: members of an array share one, so paths number
    as many as the structure has places.  ``leaf`` is the value as text, NULL for a
    JSON null.  Text that is no JSON is a leaf at ``$`` as it stands, as is a
    top-level scalar; a NULL, an empty object and an empty array have no leaves.
    Repeated rows repeat their leaves.
    """
    # own names throughout: ``keep`` may hold columns of any name
    kept = [f"__k{i}" for i in range(len(keep))]
    text, v = F.col("__text"), F.col("__v")
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(f"`{col}`").alias("__text"))
    rows = rows.where(text.isNotNull()).withColumn("__v", F.try_parse_json(text))
    plain = rows.where(v.isNull()).select(*kept, F.lit("$").alias("__path"), text.alias("__leaf"))
    level = rows.where(v.isNotNull()).select(*kept, F.lit("$").alias("__path"), "__v")
    found = [plain]
    while True:
        found.append(level.where(~_container(v)).select(*kept, "__path", F.try_variant_get(v, "$", "string").alias("__leaf")))
        inner = level.where(_container(v))
        key = F.col("key")
        step = (F.when(key.isNull(), F.lit("[*]"))
                .when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key))
                .otherwise(F.concat(F.lit('."'), key, F.lit('"'))))
        members = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
        level = materialize(members.select(*kept, F.concat("__path", step).alias("__path"), F.col("value").alias("__v")), "leaves")
        if level.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], F.col("__path").alias("path"), F.col("__leaf").alias("leaf"))
