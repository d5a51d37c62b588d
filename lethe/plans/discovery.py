"""Bulk personal-data discovery and scanning.

The reference loops over catalog columns with a cursor and runs one dynamic
``COUNT(*)`` per column and per e-mail.  Here discovery is one plan for a
whole DataFrame of subjects:

1. the catalog (table schemas, driver-side metadata only) selects candidate
   columns by name and classifies them;
2. every in-scope table is read once, only its e-mail columns, and turned
   into long form ``(table, column, value)`` with ``stack``; with few
   subjects an ``IN`` predicate on those columns reaches the scan first;
3. the long form is joined to the subjects -- broadcast when the subject set
   is proven small, otherwise pre-aggregated per value (map-side partial
   aggregation absorbs hot values) and shuffle-joined;
4. counts per (subject, table, column) get class and sensitivity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify as C
from ..operators.keyed import BROADCAST_MAX_ROWS, broadcast_if_small
from ..operators.leaves import json_leaves
from ..operators.skew import salted_join
from ..operators.subjects import count_matches, prefilter

# Databases searched by discovery.
DISCOVERY_DATABASES = ["CUSTOMER_DATA_DB", "ANALYTICS_DB", "COMPLIANCE_DB"]

_TYPE_NAMES = {T.StringType: "TEXT", T.LongType: "NUMBER", T.IntegerType: "NUMBER",
               T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP_TZ",
               T.DecimalType: "NUMBER", T.DoubleType: "FLOAT"}


def _type_name(dt: T.DataType) -> str:
    for k, v in _TYPE_NAMES.items():
        if isinstance(dt, k):
            return v
    return dt.simpleString().upper()


def _label(model, name: str) -> str:
    return model.label(name) if hasattr(model, "label") else name.upper()


def catalog_rows(model, databases=None) -> list[tuple]:
    """(database, schema, table, column, data_type) of every in-scope table.

    Metadata only: read from the tables' schemas, never from their data.
    Names are upper case, as the warehouse's catalog reports them.
    """
    dbs = set(databases or DISCOVERY_DATABASES)
    rows = []
    for name in model.names():
        db, schema = model.location(name)
        if db not in dbs:
            continue
        for f in model[name].schema.fields:
            rows.append((db, schema, _label(model, name), f.name.upper(), _type_name(f.dataType)))
    return rows


def declared_catalog_rows(tables, databases=None) -> list[tuple]:
    """``catalog_rows`` from the declared schemas alone (no session needed)."""
    from ..sources.schemas import LOCATION, SCHEMAS
    dbs = set(databases or DISCOVERY_DATABASES)
    return [(LOCATION[t][0], LOCATION[t][1], t.upper(), f.name.upper(), _type_name(f.dataType))
            for t in tables if LOCATION[t][0] in dbs for f in SCHEMAS[t].fields]


CATALOG_SCHEMA = ("database_name string, schema_name string, table_name string, "
                  "column_name string, data_type string")


def column_catalog(spark: SparkSession, model, databases=None) -> DataFrame:
    return spark.createDataFrame(catalog_rows(model, databases), CATALOG_SCHEMA)


def candidate_columns(catalog: DataFrame, intended: bool = False) -> DataFrame:
    """Catalog rows whose name marks them as personal data, classified."""
    cls = C.classify_by_name("column_name")
    return (catalog.where(C.is_candidate_column("column_name", intended))
            .withColumn("pii_classification", cls)
            .withColumn("sensitivity_level", C.sensitivity(cls)))


def _email_columns(model, databases=None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    dbs = set(databases or DISCOVERY_DATABASES)
    for name in model.names():
        if model.location(name)[0] not in dbs:
            continue
        cols = [f.name for f in model[name].schema.fields if "EMAIL" in f.name.upper()
                and isinstance(f.dataType, T.StringType)]
        if cols:
            out[name] = cols
    return out


def _long_form(model, name: str, cols: list[str], subjects: DataFrame | None = None) -> DataFrame:
    """(database, schema, table, column, value) rows of one table; with a
    few subjects, only rows that may hold one are read (scan pushdown)."""
    db, schema = model.location(name)
    stack = "stack({n}, {args}) as (column_name, value)".format(
        n=len(cols), args=", ".join(f"'{c.upper()}', cast(`{c}` as string)" for c in cols))
    src = model[name].select(*cols)
    if subjects is not None:
        src = prefilter(src, cols, subjects)
    return (src.selectExpr(stack)
            .where(F.col("value").isNotNull())
            .select(F.lit(db).alias("database_name"), F.lit(schema).alias("schema_name"),
                    F.lit(_label(model, name)).alias("table_name"), "column_name", "value"))


def _union(dfs: list[DataFrame], spark: SparkSession | None = None, schema: str = "") -> DataFrame:
    """All of ``dfs``; of none, an empty frame of ``schema``."""
    if not dfs:
        return spark.createDataFrame([], schema)
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


KEYS = ["customer_email", "database_name", "schema_name", "table_name", "column_name"]


def discover_subjects(model, subjects: DataFrame, mode: str = "observed",
                      databases=None, max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Where each subject's personal data lives.

    ``subjects`` has a ``customer_email`` column.  ``mode="observed"`` gives
    what the reference's procedure actually returns: counts on e-mail columns
    only.  ``mode="intended"`` matches a row when any of its e-mail columns
    holds the subject and reports that count on every candidate column of the
    table (name filter widened to SSN / SOCIAL / BIRTH).
    Output: customer_email, database_name, schema_name, table_name,
    column_name, pii_classification, records_found, sensitivity_level.
    """
    spark = subjects.sparkSession
    email_cols = _email_columns(model, databases)
    if mode == "observed":
        long = _union([_long_form(model, n, c, subjects) for n, c in email_cols.items()], spark,
                      "database_name string, schema_name string, table_name string, column_name string, value string")
        counts = count_matches(long, "value", subjects,
                               ["database_name", "schema_name", "table_name", "column_name"],
                               max_broadcast_rows)
        cls = C.classify_by_name("column_name")
        return counts.select(*KEYS, cls.alias("pii_classification"),
                             F.col("records_found"), C.sensitivity(cls).alias("sensitivity_level"))
    if mode != "intended":
        raise ValueError(f"unknown discovery mode {mode!r}")
    # one row per (table, row, distinct subject value among its e-mail columns)
    parts = []
    for name, cols in email_cols.items():
        db, schema = model.location(name)
        vals = F.array_distinct(F.filter(F.array(*[F.col(c) for c in cols]),
                                         lambda x: x.isNotNull()))
        src = prefilter(model[name].select(*cols), cols, subjects)
        parts.append(src.select(F.explode(vals).alias("value")).select(
            F.lit(db).alias("database_name"), F.lit(schema).alias("schema_name"),
            F.lit(_label(model, name)).alias("table_name"), "value"))
    per_table = count_matches(_union(parts, spark, "database_name string, schema_name string, table_name string, value string"),
                              "value", subjects,
                              ["database_name", "schema_name", "table_name"], max_broadcast_rows)
    cands = candidate_columns(column_catalog(spark, model, databases), intended=True).select(
        "database_name", "schema_name", "table_name", "column_name", "pii_classification",
        "sensitivity_level")
    # the candidate list is catalog metadata: broadcast once measured
    j = per_table.join(broadcast_if_small(cands), ["database_name", "schema_name", "table_name"])
    return j.select(*KEYS, "pii_classification", "records_found", "sensitivity_level")


def sort_discovery(discovered: DataFrame, by_severity: bool = False) -> DataFrame:
    """Reference order (sensitivity text DESC, records DESC) or by severity."""
    if by_severity:
        return discovered.orderBy(C.severity_rank("sensitivity_level").desc(),
                                  F.col("records_found").desc())
    return discovered.orderBy(F.col("sensitivity_level").desc(), F.col("records_found").desc())


def discovery_results(discovered: DataFrame, requests: DataFrame) -> DataFrame:
    """DATA_DISCOVERY_RESULTS rows: discovery joined back to each request of
    the subject, carrying the erasure request id (so processing finds them)."""
    r = requests.select("request_id", "customer_email")
    # a subject may have many requests: the requests are the salted side
    d = discovered.withColumnRenamed("customer_email", "__subject")
    j = salted_join(r, d, "customer_email", "__subject", "inner")
    return j.select(
        F.concat(F.lit("DISC_"), F.substring(F.sha2(F.concat_ws(
            "|", "request_id", "database_name", "schema_name", "table_name", "column_name"),
            256), 1, 16), F.lit("_"), F.replace(F.col("customer_email"), F.lit("@"),
                                                 F.lit("_AT_"))).alias("discovery_id"),
        "request_id", "customer_email", "database_name", "schema_name", "table_name",
        "column_name", "pii_classification", "records_found",
        F.col("sensitivity_level").isin("HIGH", "CRITICAL").alias("sensitive_data_detected"),
        F.lit(True).alias("can_be_deleted"))


def discovery_summary(discovered: DataFrame) -> DataFrame:
    """Per subject: total records, systems (databases), HIGH items."""
    return (discovered.groupBy("customer_email")
            .agg(F.sum("records_found").cast("long").alias("total_records"),
                 F.count_distinct("database_name").alias("systems_affected"),
                 F.count(F.when(F.col("sensitivity_level") == "HIGH", 1)).alias("high_sensitivity_items")))


def distinct_tables(discovered: DataFrame) -> DataFrame:
    return (discovered.where(F.col("records_found") > 0)
            .select("customer_email", "database_name", "schema_name", "table_name").distinct())


# --- content scanning ----------------------------------------------------------

SCAN_PATTERNS = {"email": C.EMAIL_RE, "ssn": C.SSN_RE, "phone": C.PHONE_RE, "date": C.DATE_RE}


def _pattern_hits(v: Column) -> list[Column]:
    """Per pattern, how many values have a partial match."""
    hits = {
        "email": F.when(F.instr(v, "@") > 0, v.rlike(C.EMAIL_RE)).otherwise(F.lit(False)),
        "ssn": v.rlike(C.SSN_RE), "phone": v.rlike(C.PHONE_RE), "date": v.rlike(C.DATE_RE),
    }
    return [F.count(F.when(h, 1)).alias(f"{k}_hits") for k, h in hits.items()]


def pii_scan(tables: dict[str, DataFrame], text_columns: dict[str, list[str]]) -> DataFrame:
    """Per (table, column): rows scanned and rows with a partial match of
    each personal-data pattern, plus the share of e-mail hits.  One pass per
    table; the ``@`` guard skips the e-mail regex on rows without one."""
    parts = []
    for name, cols in text_columns.items():
        df = tables[name]
        stack = "stack({n}, {args}) as (column_name, v)".format(
            n=len(cols), args=", ".join(f"'{c}', cast(`{c}` as string)" for c in cols))
        long = df.select(*cols).selectExpr(stack)
        v = F.col("v")
        agg = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("rows_scanned"), F.count(v).alias("non_null"),
                                              *_pattern_hits(v))
        parts.append(agg.select(F.lit(name).alias("table_name"), "*"))
    out = _union(parts)
    return out.withColumn("email_share",
                          F.round(F.col("email_hits") / F.greatest(F.col("rows_scanned"), F.lit(1)), 6))


def pii_scan_leaves(tables: dict[str, DataFrame], json_columns: dict[str, list[str]]) -> DataFrame:
    """``pii_scan`` inside semi-structured columns: per (table, column, path)
    the leaves, those not null, those with a partial match of each pattern,
    and the share of e-mail hits.  One walk and one aggregate for all columns."""
    parts = []
    for name, cols in json_columns.items():
        for c in cols:
            leaves = json_leaves(tables[name], c)
            parts.append(leaves.select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "path", "leaf"))
    leaf = F.col("leaf")
    out = _union(parts).groupBy("table_name", "column_name", "path").agg(
        F.count(F.lit(1)).alias("leaves"), F.count(leaf).alias("non_null"), *_pattern_hits(leaf))
    return out.withColumn("email_share", F.round(F.col("email_hits") / F.greatest(F.col("leaves"), F.lit(1)), 6))


REDACTIONS = [("email", C.EMAIL_RE, "[EMAIL]"), ("ssn", C.SSN_RE, "[SSN]"),
              ("phone", C.PHONE_RE, "[PHONE]")]


def pii_text_redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Replace e-mails, SSNs and phone numbers in free text with tags and
    count the replacements (whole text, every occurrence)."""
    t = F.col(text_col)
    # counts are taken on the text as redacted by the previous steps
    cols = [F.col(id_col)]
    step = t
    for name, pat, tag in REDACTIONS:
        # cheap guards: no '@' means no e-mail, no '-' means no SSN
        guard = {"email": F.instr(step, "@") > 0, "ssn": F.instr(step, "-") > 0}.get(name, F.lit(True))
        cols.append(F.when(guard, F.size(F.regexp_extract_all(step, F.lit(pat), 0)))
                    .otherwise(F.when(step.isNotNull(), F.lit(0))).cast("long").alias(f"{name}_found"))
        step = F.when(guard, F.regexp_replace(step, pat, tag)).otherwise(step)
    cols.append(step.alias("redacted_text"))
    return df.select(*cols)


ACCESS_TERMS = ["%customer%", "%email%", "%personal%"]


def access_audit(log: DataFrame, text_col: str, order_col: str, keep: list[str]) -> DataFrame:
    """Entries of a query/text log that touch customer data, with the first
    e-mail address found in the text; newest first."""
    t = F.col(text_col)
    cond = t.ilike(ACCESS_TERMS[0])
    for term in ACCESS_TERMS[1:]:
        cond = cond | t.ilike(term)
    return (log.where(cond)
            .select(*keep, F.regexp_substr(t, F.lit(C.EMAIL_RE)).alias("customer_email_accessed"))
            .orderBy(F.col(order_col).desc()))
