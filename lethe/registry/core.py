"""Registry plumbing shared by the query modules.

A registered query is a Spark callable ``(spark, sf_dir) -> DataFrame`` and,
when the operator is expressible in SQL, an oracle statement for DuckDB over
the raw driver views.  Result columns are made comparable across engines by
``canon``: dates and timestamps become ISO text, decimals become doubles and
narrow integers become longs.
The oracle side does the same with ``canon_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from ..sources.derived import ComplianceModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def canon(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def canon_sql(sql: str, text_cols: list[str] = (), double_cols: list[str] = ()) -> str:
    """Wrap an oracle statement so the listed columns match ``canon``."""
    reps = [f"CAST({c} AS VARCHAR) AS {c}" for c in text_cols]
    reps += [f"CAST({c} AS DOUBLE) AS {c}" for c in double_cols]
    if not reps:
        return sql
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql}\n) AS q"


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(model) -> DataFrame`` as query ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return canon(fn(ComplianceModel(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
