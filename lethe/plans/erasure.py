"""Erasure: delete or pseudonymize a batch of subjects across tables, log
the operations, and verify the result against the tables as they were.

A table is marked once: a left join to the subject set (broadcast only when the
set is proven small, otherwise a shuffle join with NULL keys spread and keys
salted) says whose each row is and whether it goes.  Tables without an e-mail
column are reached along the declared keys, from the erased rows of their parent.
``write_erased`` turns the marks into the table's next contents and a log of the
rows concerned in one job; the rows it read, kept and erased are observed on that
job.  Nothing is updated in place (see ``sources.state``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify as C
from ..operators import subjects as S
from ..operators.keyed import BROADCAST_MAX_ROWS, count_if, is_small
from ..operators.skew import salted_join
from ..session import materialize as write_and_read
from ..sources.state import LOG, NEXT, PART, StateFolder

# Databases erasure may touch (the compliance database holds
# the requests and the audit trail and is never erased from).
ERASURE_DATABASES = ["CUSTOMER_DATA_DB", "ANALYTICS_DB"]
PSEUDONYM_PREFIX = "PSEUDONYM_"
PSEUDONYM_ID_PREFIX = "PID_"
# Declared foreign keys, (child, column, parent, parent's key).
DECLARED_KEYS = [("user_preferences", "customer_id", "customers", "customer_id"),
                 ("orders", "customer_id", "customers", "customer_id"),
                 ("order_items", "order_id", "orders", "order_id"),
                 ("support_tickets", "customer_id", "customers", "customer_id"),
                 ("customer_ml_features", "customer_id", "customers", "customer_id"),
                 ("data_discovery_results", "request_id", "erasure_requests", "request_id"),
                 ("erasure_operations", "request_id", "erasure_requests", "request_id"),
                 ("third_party_notifications", "request_id", "erasure_requests", "request_id")]


def _date(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def email_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if "EMAIL" in f.name.upper() and isinstance(f.dataType, T.StringType)]


def subjects_to_erase(plan: DataFrame, materialize: bool = True) -> DataFrame:
    """Distinct subjects whose request the plan lets through.

    The set feeds one job per table plus the log and the verification, so
    by default it is written once into the shared checkpoint folder: later
    jobs read the small materialized set instead of re-running the request /
    hold plan, and a lost executor cannot force that re-run."""
    s = (plan.where(F.col("decision") == "IN_PROGRESS")
         .select("customer_email").where(F.col("customer_email").isNotNull()).distinct())
    if materialize:
        s = write_and_read(s, "erase-subjects")
    return s


def tag_rows(df: DataFrame, subjects: DataFrame, cols: list[str] | None = None,
             max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` plus ``__subject``: the subject a row belongs to (NULL if none).

    A row belongs to a subject when any of its e-mail columns equals it."""
    cols = cols if cols is not None else email_columns(df)
    return S.tag_rows(df, subjects, cols, max_broadcast_rows)


def row_hold(df: DataFrame, as_of) -> Column:
    """Row-level legal hold: not deletable, or under legal retention."""
    cond = F.lit(False)
    if "can_be_deleted" in df.columns:
        cond = cond | (F.col("can_be_deleted") == F.lit(False))
    if "legal_retention_until" in df.columns:
        cond = cond | (F.col("legal_retention_until") > _date(as_of))
    return F.coalesce(cond, F.lit(False))


def pseudonym(email: Column, salt: str) -> Column:
    return F.concat(F.lit(PSEUDONYM_PREFIX), F.sha2(F.concat(F.lit(salt), email), 256))


def pseudonym_id(email: Column, salt: str) -> Column:
    return F.concat(F.lit(PSEUDONYM_ID_PREFIX),
                    F.substring(F.sha2(F.concat(F.lit(salt + "|id|"), email), 256), 1, 16))


def rows_per_subject(tagged: DataFrame) -> DataFrame:
    """Tagged rows counted for every subject they belong to."""
    return (tagged.select(F.explode("__subjects").alias("customer_email")).groupBy("customer_email")
            .agg(F.count(F.lit(1)).alias("records_affected")))


def mark_rows(df: DataFrame, subjects: DataFrame, operation: str, as_of=None, honour_row_holds: bool = True,
              cols: list[str] | None = None) -> DataFrame:
    """``df`` plus ``__subjects`` (whose row it is), ``__subject`` (the first of them, NULL for
    nobody's) and ``__hit``: whether the operation applies to it (held rows are not deleted)."""
    t = tag_rows(df, subjects, cols)
    hit = F.col("__subject").isNotNull()
    if operation == "DELETE" and honour_row_holds:
        hit = hit & ~row_hold(df, as_of)
    return t.withColumn("__hit", hit)


def mark_by_key(df: DataFrame, key: str, owners: DataFrame) -> DataFrame:
    """``mark_rows`` along a key: a row is its parent's subjects'.  ``owners``: __key, __subjects."""
    if is_small(owners.select("__key")):
        t = df.join(F.broadcast(owners), df[key] == owners["__key"], "left")
    else:
        t = salted_join(df, owners, key, "__key", "left")
    return (t.drop("__key").withColumn("__subject", F.get("__subjects", F.lit(0)))
            .withColumn("__hit", F.col("__subject").isNotNull()))


def owners_of(rows: DataFrame, key: str) -> DataFrame:
    """__key and __subjects of the erased ones among marked ``rows`` (a key's subjects are few)."""
    return (rows.where("__hit").where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.explode("__subjects").alias("s"))
            .groupBy("__key").agg(F.sort_array(F.collect_set("s")).alias("__subjects")))


def next_columns(columns: list[str], operation: str, salt: str, cols: list[str], key: str | None = None) -> list[Column]:
    """The columns of a marked row in the table's next contents.

    PSEUDONYMIZE replaces the subjects' own e-mails by a salted hash (in a table reached
    by ``key`` that column), flags the row and gives it a pseudonym id; other people's
    e-mails in the same row and all other columns stay."""
    out = []
    for c in columns:
        new = None
        if operation == "PSEUDONYMIZE":
            if c in cols:
                own = F.coalesce(F.array_contains("__subjects", F.col(c)), F.lit(False))
                new = F.when(own, pseudonym(F.col(c), salt)).otherwise(F.col(c))
            elif c == key:
                new = F.when(F.col("__hit"), pseudonym(F.col("__subject"), salt)).otherwise(F.col(c))
            elif c == "is_pseudonymized":
                new = F.when(F.col("__hit"), F.lit(True)).otherwise(F.col(c))
            elif c == "pseudonym_id":
                new = F.when(F.col("__hit"), pseudonym_id(F.col("__subject"), salt)).otherwise(F.col(c))
        out.append((F.col(c) if new is None else new).alias(c))
    return out


def next_rows(marked: DataFrame, columns: list[str], operation: str, salt: str, cols: list[str], key: str | None = None) -> DataFrame:
    """The table's next contents from its marked rows."""
    rows = marked.where(~F.col("__hit")) if operation == "DELETE" else marked
    return rows.select(*next_columns(columns, operation, salt, cols, key))


def erase_delete(df: DataFrame, subjects: DataFrame, as_of, honour_row_holds: bool = True,
                 cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows kept after deleting the subjects' rows, and per-subject counts
    of deleted rows.  Held rows stay when ``honour_row_holds``."""
    cols = cols if cols is not None else email_columns(df)
    kept = next_rows(mark_rows(df, subjects, "DELETE", as_of, honour_row_holds, cols), df.columns, "DELETE", "", cols)
    # the counts only need the subjects' rows: with few subjects the scan
    # behind them skips row groups (IN pushdown) instead of re-reading all
    hit = mark_rows(S.prefilter(df, cols, subjects), subjects, "DELETE", as_of, honour_row_holds, cols)
    return kept, rows_per_subject(hit.where("__hit"))


def erase_pseudonymize(df: DataFrame, subjects: DataFrame, salt: str,
                       cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with the subjects' rows pseudonymized (``next_columns``), and per-subject counts."""
    cols = cols if cols is not None else email_columns(df)
    table = next_rows(mark_rows(df, subjects, "PSEUDONYMIZE", cols=cols), df.columns, "PSEUDONYMIZE", salt, cols)
    hit = mark_rows(S.prefilter(df, cols, subjects), subjects, "PSEUDONYMIZE", cols=cols)
    return table, rows_per_subject(hit.where("__hit"))


def write_erased(marked: DataFrame, columns: list[str], operation: str, salt: str, cols: list[str],
                 path: str, key: str | None = None) -> dict:
    """Write a marked table's next contents and its log in one job, under ``path``.

    A row that stays gives a NEXT row; a subject's row also gives a LOG row, with its
    e-mail and key columns as they were and the marks.  Returns ``table`` and ``log``, read
    back, and ``rows``: rows read, written and affected, observed on the writing job."""
    stays = ~F.col("__hit") if operation == "DELETE" else F.lit(True)
    touched = F.col("__subject").isNotNull()
    parts = F.when(~touched, F.array(F.lit(NEXT))).when(stays, F.array(F.lit(NEXT), F.lit(LOG))).otherwise(F.array(F.lit(LOG)))
    shown = {*cols, *[c for c in columns if c.endswith("_id")]}
    is_next = F.col(PART) == NEXT
    rows = marked.withColumn(PART, F.explode(parts)).select(
        *[F.when(is_next, new).otherwise(F.col(c) if c in shown else F.lit(None)).alias(c)
          for c, new in zip(columns, next_columns(columns, operation, salt, cols, key))],
        F.when(~is_next, F.col("__subjects")).alias("__subjects"), F.when(~is_next, F.col("__hit")).alias("__hit"), PART)
    seen = Observation()
    rows = rows.observe(seen, count_if(is_next).alias("rows_written"), count_if(~is_next & F.col("__hit")).alias("rows_affected"))
    rows.write.mode("overwrite").partitionBy(PART).parquet(path)
    spark = marked.sparkSession
    if not seen.get["rows_written"]:  # nothing is left: the table keeps its columns
        spark.createDataFrame([], rows.drop(PART).schema).write.parquet(f"{path}/{PART}={NEXT}")
    back = spark.read.schema(rows.schema).parquet(path)
    log = back.where(F.col(PART) == LOG).drop(PART).withColumn("__subject", F.get("__subjects", F.lit(0)))
    return {"table": back.where(is_next).select(*columns), "log": log, "rows": seen.get}


#: Columns that say whether a row is held.
HOLD_COLUMNS = ["can_be_deleted", "legal_retention_until"]
FILE = "__file"


def rewrite_files(state: StateFolder, name: str, mark: Callable[[DataFrame], DataFrame], subjects: DataFrame,
                  operation: str, salt: str, cols: list[str], key: str | None = None) -> dict:
    """``write_erased`` of only those files of a kept table that hold a subject's row.

    A first pass reads the e-mail, key and hold columns (few subjects are pushed into its scan)
    and finds the files; their rows alone are read whole and written anew, and the commit puts
    these in the files' place.  All other files keep their names and are not read again.  Returns
    the same as ``write_erased`` (``table`` is the whole next table, ``rows`` counts what was
    written) and ``files``, the replaced ones; without any, nothing is written."""
    t = state.read(name, FILE)
    columns = [c for c in t.columns if c != FILE]
    schema = t.select(*columns).schema
    need = [c for c in columns if c in {*cols, *HOLD_COLUMNS, key}]
    mine = mark(S.prefilter(t.select(*need, FILE), cols, subjects)).where(F.col("__subject").isNotNull())
    files = sorted(r[0] for r in mine.select(FILE).distinct().collect())
    if not files:
        log = state.spark.createDataFrame([], schema).withColumns({
            "__subjects": F.array().cast("array<string>"), "__hit": F.lit(False), "__subject": F.lit(None).cast("string")})
        return {"table": state.read(name), "log": log, "rows": {"rows_written": 0, "rows_affected": 0}, "files": files}
    run, path = state.new_part(name)
    done = write_erased(mark(state.read_files(name, files, schema)), columns, operation, salt, cols, path, key)
    rest = sorted(set(state.files(name)) - set(files))
    if rest:
        done["table"] = state.read_files(name, rest, schema).unionByName(done["table"])
    state.replace_files(name, run, files)
    return {**done, "files": files}


def mark_erased(df: DataFrame, subjects: DataFrame, as_of, since, at) -> DataFrame:
    """``df`` as a history: every row valid from ``since``, those an erasure at
    ``at`` removes valid until then (``valid_from``, ``valid_to``)."""
    cols = email_columns(df)
    t = tag_rows(df, subjects, cols)
    gone = F.col("__subject").isNotNull() & ~row_hold(df, as_of)
    return t.select(*df.columns, F.lit(since).cast("timestamp").alias("valid_from"),
                    F.when(gone, F.lit(at).cast("timestamp")).alias("valid_to"))


def valid_at(history: DataFrame, ts) -> DataFrame:
    """The rows of a history in force at ``ts``, without its two columns."""
    at = F.lit(ts).cast("timestamp")
    live = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return history.where(live).drop("valid_from", "valid_to")


def full_name(model, name: str) -> str:
    """DATABASE.SCHEMA.TABLE of a model's table."""
    label = model.label(name) if hasattr(model, "label") else name.upper()
    return ".".join((*model.location(name), label))


def erasure_targets(model, databases=None) -> list[tuple[str, str, str, str]]:
    """(table, database, schema, operation) for every erasable table."""
    out = []
    dbs = set(databases or ERASURE_DATABASES)
    for name in model.names():
        db, schema = model.location(name)
        if db not in dbs:
            continue
        op = "PSEUDONYMIZE" if (db == C.PSEUDONYMIZE_DB and schema in C.PSEUDONYMIZE_SCHEMAS) else "DELETE"
        out.append((name, db, schema, op))
    return out


def plan_erasure(model, subjects: DataFrame, as_of, salt: str, honour_row_holds: bool = True, databases=None,
                 write: Callable[[str], str] | None = None, state: StateFolder | None = None) -> dict[str, dict]:
    """For each erasable table: its next contents, per-subject counts, the rows concerned as
    they were (``log``), and status SUCCESS, SKIPPED (no way leads from a subject to the
    table) or FAILED (with the error).

    A table is reached by its e-mail columns or, where it has none, along a declared key
    from the erased rows of a table reached before it.  With ``write`` (table name to
    folder) each table is written when its turn comes, and one that fails while its job
    runs is FAILED as well as one that cannot be planned; without it nothing is written
    but the keys that lead to other tables.  Of a table that ``state`` keeps only the files
    that hold a subject are written (``rewrite_files``)."""
    out: dict[str, dict] = {}
    parents = {p for _, _, p, _ in DECLARED_KEYS}

    def attempt(name: str, e: dict, df: DataFrame, cols: list[str], key: str | None, mark: Callable[[DataFrame], DataFrame]) -> None:
        columns, op = df.columns, e["operation"]
        if state is not None and state.has(name):
            done = rewrite_files(state, name, mark, subjects, op, salt, cols, key)
        elif write is not None:
            done = write_erased(mark(df), columns, op, salt, cols, write(name), key)
        else:
            ids = [c for c in columns if c.endswith("_id")]
            log = mark(S.prefilter(df, cols, subjects)).where(F.col("__subject").isNotNull()).select(
                *dict.fromkeys([*cols, *ids]), "__subjects", "__subject", "__hit")
            if name in parents:  # read once, for its own counts and for its children's
                log = write_and_read(log, f"erased-{name}")
            done = {"table": next_rows(mark(df), columns, op, salt, cols, key), "log": log, "rows": None}
        e.update(status="SUCCESS", cols=cols, key=key, affected=rows_per_subject(done["log"].where("__hit")), **done)

    def by_email(name: str) -> None:
        e = out[name]
        try:
            df = e["table"] = model[name]
            cols = email_columns(df)
            if cols:
                attempt(name, e, df, cols, None, lambda t: mark_rows(t, subjects, e["operation"], as_of, honour_row_holds, cols))
            else:
                e.update(status="SKIPPED", error="no way from a subject to this table")
        except Exception as error:  # noqa: BLE001 - per-table failure is logged, as the reference does
            e.update(status="FAILED", affected=None, error=str(error))

    def by_key(name: str, key: str, parent: str, parent_key: str) -> None:
        e = out[name]
        try:
            if out[parent]["status"] != "SUCCESS":
                raise RuntimeError(f"{parent}, through which this table is reached, is {out[parent]['status']}")
            owners = owners_of(out[parent]["log"], parent_key)
            if write is not None:  # measured, joined and searched for again: read once
                owners = write_and_read(owners, f"owners-{name}")
            e["owners"] = owners
            attempt(name, e, e["table"], [], key, lambda t: mark_by_key(t, key, owners))
            e["error"] = None
        except Exception as error:  # noqa: BLE001
            e.update(status="FAILED", affected=None, error=str(error))

    for name, db, schema, op in erasure_targets(model, databases):
        out[name] = {"database": db, "schema": schema, "operation": op, "error": None, "table": None, "affected": None,
                     "label": model.label(name) if hasattr(model, "label") else name.upper()}
    S.few_subject_keys(subjects), S.subject_side(subjects, "s")  # measured once, not by each table's thread
    _side_by_side(by_email, [(name,) for name in out])
    later = [name for name, e in out.items() if e["status"] == "SKIPPED"]
    while later:  # along the keys, until no further table is reached
        ways = {}
        for c, k, p, pk in DECLARED_KEYS:
            if c in later and p in out and p not in later and k in out[c]["table"].columns:
                ways.setdefault(c, (c, k, p, pk))
        if not ways:
            break
        later = [name for name in later if name not in ways]
        _side_by_side(by_key, list(ways.values()))
    return out


#: Tables whose jobs run at a time: the last tasks and small jobs of one leave no core idle.
TABLES_AT_A_TIME = 4


def _side_by_side(work: Callable, each: list[tuple]) -> None:
    """Tables that do not depend on each other, some at a time (threads of the driver that wait for their jobs)."""
    with ThreadPoolExecutor(TABLES_AT_A_TIME) as pool:
        list(pool.map(lambda args: work(*args), each))


def operation_log(planned: dict[str, dict], requests: DataFrame) -> DataFrame:
    """ERASURE_OPERATIONS-style rows.

    SUCCESS: one row per (request, table) where the subject had rows, with
    the number of rows the operation touched.  FAILED: a table whose plan
    could not be built or written gets one row per request, with the error text
    and no count (the reference logs SQLERRM the same way).  SKIPPED tables, to which
    neither an e-mail nor a declared key leads, are not logged."""
    spark = requests.sparkSession
    r = requests.select("request_id", "customer_email")
    parts = []
    failed = []
    for name, e in planned.items():
        label = e.get("label", name.upper())
        if e["status"] == "FAILED":
            failed.append(F.struct(F.lit(e["database"]).alias("target_database"),
                                   F.lit(e["schema"]).alias("target_schema"),
                                   F.lit(label).alias("target_table"),
                                   F.lit(e["operation"]).alias("operation_type"),
                                   F.lit(e["error"]).alias("error_message")))
        if e["affected"] is None:
            continue
        parts.append(e["affected"].select(
            "customer_email", F.col("records_affected").cast("long").alias("records_affected"),
            F.lit(e["database"]).alias("target_database"), F.lit(e["schema"]).alias("target_schema"),
            F.lit(label).alias("target_table"), F.lit(e["operation"]).alias("operation_type"),
            F.lit(e["status"]).alias("operation_status"),
            F.lit(None).cast("string").alias("error_message")))
    out = None
    if parts:
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        # per-subject counts of all tables meet the requests in one join
        # (a subject may have many requests: the requests are the salted side)
        out = salted_join(r, u.withColumnRenamed("customer_email", "__subject"), "customer_email",
                          "__subject", "inner").drop("__subject")
    if failed:
        f = r.select("customer_email", "request_id", F.explode(F.array(*failed)).alias("f")).select(
            "customer_email", F.lit(None).cast("long").alias("records_affected"),
            "f.target_database", "f.target_schema", "f.target_table", "f.operation_type",
            F.lit("FAILED").alias("operation_status"), "f.error_message", "request_id")
        out = f if out is None else out.unionByName(f)
    if out is None:
        return spark.createDataFrame([], "operation_id string, request_id string")
    return out.select(
        F.concat(F.lit("OP_"), F.substring(F.sha2(F.concat_ws("|", "request_id", "target_database",
                                                              "target_schema", "target_table"), 256),
                                           1, 24)).alias("operation_id"),
        "request_id", "operation_type", "target_database", "target_schema", "target_table",
        "operation_status", "records_affected", "error_message")


def deletion_summary(op_log: DataFrame) -> DataFrame:
    """Per request: JSON object table → rows affected (keys sorted), over
    the successful operations."""
    entry = F.struct(F.concat_ws(".", "target_database", "target_schema", "target_table").alias("k"),
                     F.col("records_affected").alias("v"))
    return (op_log.where(F.col("operation_status") == "SUCCESS").groupBy("request_id")
            .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))))
                 .alias("deletion_summary")))


# --- verification ---------------------------------------------------------------

def _summed(parts: list[DataFrame]) -> DataFrame:
    """Signed rows of all tables, added up per (table, subject) in one aggregate."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("table_name", "customer_email").agg(
        F.sum("b").alias("records_before"), F.sum("a").alias("records_after"))


def verify_counts(before: dict[str, DataFrame], after: dict[str, DataFrame],
                  scope: list[tuple[str, str]], subjects: DataFrame,
                  max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Per-subject row counts before and after, for each (full table name, e-mail column) in
    ``scope``; ``before`` and ``after`` are keyed by full table name.

    Rows of the old tables count for before, those of the new ones for after: one union,
    one match with the subjects and one aggregate, each table read once, no outer join."""
    parts = []
    for full, col in scope:
        for rows, b, a in ((before[full], 1, 0), (after[full], 0, 1)):
            src = S.prefilter(rows.select(col), [col], subjects)
            parts.append(src.select(F.lit(full).alias("table_name"), F.col(col).alias("value"),
                                    F.lit(b).cast("long").alias("b"), F.lit(a).cast("long").alias("a")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    long = u.where(F.col("value").isNotNull()).groupBy("table_name", "value").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    side, _ = S.subject_side(subjects, "__subject", max_broadcast_rows)
    return long.join(side, long["value"] == side["__subject"]).select(
        "table_name", F.col("__subject").alias("customer_email"), F.col("b").alias("records_before"), F.col("a").alias("records_after"))


def verify_planned(planned: dict[str, dict], model, labelled: list[tuple[str, str]] | None = None,
                   subjects: DataFrame | None = None) -> DataFrame | None:
    """``verify_counts`` of a planned or written erasure.  Rows before come from its log, so
    no table as it was is read again; None where nothing is checked.

    Tables with e-mails are checked in their ``labelled`` (full table name, column) columns,
    by default in all, tables reached along a key by that key.  With ``subjects`` the next
    contents are searched for them again, else rows after come from the plan itself."""
    parts = []
    for name, e in planned.items():
        if e["status"] != "SUCCESS":
            continue
        full = full_name(model, name)
        row = lambda b, a: [F.lit(full).alias("table_name"), "customer_email", b.cast("long").alias("b"), a.cast("long").alias("a")]  # noqa: E731,B023
        for c in e["cols"] or [None]:
            if c and labelled is not None and (full, c) not in labelled:
                continue
            log = (e["log"] if c else e["log"].where("__hit")).withColumn("customer_email", F.explode("__subjects"))
            if c:
                log = log.where(F.col(c) == F.col("customer_email"))
            if subjects is None:
                parts.append(log.select(*row(F.lit(1), F.when(F.col("__hit"), 0).otherwise(1))))
                continue
            parts.append(log.select(*row(F.lit(1), F.lit(0))))
            if c:
                found = S.count_matches(S.prefilter(e["table"].select(c), [c], subjects), c, subjects, [], name="n")
            else:
                left = mark_by_key(e["table"].select(e["key"]), e["key"], e["owners"]).where("__hit")
                found = left.select(F.explode("__subjects").alias("customer_email")).withColumn("n", F.lit(1))
            parts.append(found.select(*row(F.lit(0), F.col("n"))))
    return _summed(parts) if parts else None


def verify_deletion(counts: DataFrame) -> DataFrame:
    """Verified when nothing remains; rows with both counts zero dropped;
    unverified first, then by rows before."""
    b, a = F.col("records_before"), F.col("records_after")
    return (counts.where((b > 0) | (a > 0))
            .withColumn("deletion_verified", ((b > 0) & (a == 0)) | ((b == 0) & (a == 0)))
            .orderBy(F.col("deletion_verified").asc(), b.desc()))


def verify_all(verified: DataFrame) -> DataFrame:
    """Per subject: every table verified?, and the failing tables."""
    return (verified.groupBy("customer_email").agg(
        F.bool_and("deletion_verified").alias("all_verified"),
        F.array_join(F.array_sort(F.collect_list(
            F.when(~F.col("deletion_verified"), F.col("table_name")))), ",").alias("failed_tables"),
        count_if(~F.col("deletion_verified")).alias("failed_count")))


def scope_from_classification(classification: DataFrame) -> list[tuple[str, str]]:
    """(DB.SCHEMA.TABLE, column) of columns labelled EMAIL_ADDRESS -- a
    handful of metadata rows, collected on purpose."""
    rows = (classification.where(F.col("pii_type") == "EMAIL_ADDRESS")
            .select(F.concat_ws(".", "database_name", "schema_name", "table_name").alias("t"),
                    "column_name").distinct().collect())
    return sorted((r["t"], r["column_name"]) for r in rows)
