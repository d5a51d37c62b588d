"""Helpers shared by the operators: column selection, lineage cuts, hot-key-safe joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path  # noqa: F401  (re-exported)

#: Words as every contract defines them: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sub-keys a hot key is spread over.
SALTS = 512
#: A table is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, by exact case; other columns, also ones that
    differ in case only, or repeat a name, are left aside."""
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    by_place = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def framed(df: DataFrame, *names: str) -> DataFrame:
    """All columns of ``df`` under names of their places (_c0, ...), and the named ones once
    more under their own: work on these cannot clash with other columns.  ``restored`` goes back."""
    by_place = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return by_place.select("*", *[F.col(f"_c{df.columns.index(n)}").alias(n) for n in names])


def restored(frame: DataFrame, df: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``df`` from what became of its ``framed`` form, some of them changed."""
    return frame.select(*[changed.get(c, F.col(f"_c{i}")) if df.columns.index(c) == i else F.col(f"_c{i}")
                          for i, c in enumerate(df.columns)]).toDF(*df.columns)


def bucket(n: int, *by: Column | str) -> Column:
    """A row's place among ``n`` by a hash of ``by`` (nulls included)."""
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def attach(df: DataFrame, small: DataFrame, keys: list[str], by: list[str], salts: int = SALTS,
           how: str = "inner") -> DataFrame:
    """``df`` joined to ``small`` (one row per key), with no task holding a whole hot key.

    Rows are dealt over ``salts`` sub-keys by a hash of ``by``.  The distinct
    (key, sub-key) pairs, combined map-side, meet ``small`` first; each row then
    meets its own pair.  Keys must not be null.
    """
    dealt = df.withColumn("_salt", bucket(salts, *by))
    pairs = dealt.select(*keys, "_salt").distinct()
    return dealt.join(pairs.join(small, keys), [*keys, "_salt"], how).drop("_salt")


def attach_small(df: DataFrame, small: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``attach``, or a broadcast join when ``small`` measures below BROADCAST_BYTES."""
    width = sum((F.octet_length(F.col(c).cast("string")) for c in small.columns), F.lit(0)) + 16 * len(small.columns)
    size = small.agg(F.sum(F.coalesce(width, F.lit(64)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), keys, how)
    return attach(df, small, keys, by, how=how)


def ranked(df: DataFrame, within: list[str], order: list[str], out: str, salts: int = SALTS) -> DataFrame:
    """``df`` plus ``out``: a gapless number from 0 within each ``within`` key.

    Rows are dealt by a hash of ``order`` over ``salts`` cells of the key; a
    cell's first number is the count of the cells before it, so no window holds
    a whole key.  Ties in ``order`` are numbered in any order.
    """
    from pyspark.sql import Window
    d = df.withColumn("_cell", bucket(salts, *order))
    cells = d.groupBy(*within, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*within, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy(*within, "_cell").orderBy(*order)
    numbered = d.withColumn("_i", F.row_number().over(own) - 1)
    return (numbered.join(starts, [*within, "_cell"])
            .withColumn(out, (F.col("_from") + F.col("_i")).cast("long"))
            .drop("_cell", "_from", "_i"))


def sums_before(df: DataFrame, order: list[Column | str], what: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``df`` plus, for each entry of ``what``, the sum of its column over the rows before in
    ``order`` (0 for the first); and the sums over all rows, by name.

    Rows are sorted by ranges and written once with their partition; a window holds one range,
    and only one row a partition meets in one place, the driver.
    """
    from pyspark.sql import Window
    spark = df.sparkSession
    own = {f"_v{i}": c for i, c in enumerate(what.values())}
    held = materialize(df.withColumns(own).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sums")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    totals, starts = [0] * len(own), []
    for part, *sums in sorted(held.groupBy("_part").agg(*[F.sum(v) for v in own]).collect()):
        starts.append((part, *totals))
        totals = [a + b for a, b in zip(totals, sums)]
    kinds = dict(held.dtypes)
    table = spark.createDataFrame([(p, *[float(t) if kinds[v] == "double" else t for v, t in zip(own, s)]) for p, *s in starts],
                                  ", ".join(["_part long", *[f"_from{v} {kinds[v]}" for v in own]]))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.join(F.broadcast(table), "_part").withColumns(
        {n: F.col(f"_from{v}") + F.coalesce(F.sum(v).over(before), F.lit(0).cast(kinds[v])) for n, v in zip(what, own)})
    return placed.drop("_at", "_part", *own, *[f"_from{v}" for v in own]), dict(zip(what, totals))


def meetings(rows: DataFrame, spread: str, part: int) -> DataFrame:
    """Rows (t, key, ...) of buckets with more than one row, dealt so that all of a bucket's rows
    meet in pairs of parts of about ``part`` rows: columns i, j (the pair) and part (the row's own).

    A bucket of any size is spread over tasks (t, key, i, j); every two of its rows meet
    in exactly one of them.  ``spread`` names a column that differs within a bucket.
    """
    crowds = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "t", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    dealt = attach(rows, crowds, ["t", "key"], [spread]).withColumn("part", F.pmod(F.xxhash64(spread), F.col("parts")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = [c for c in rows.columns if c not in ("t", "key")]
    tasks = pairs.select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *own)
    return tasks.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "part")
