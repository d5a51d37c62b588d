"""Registered queries: streaming operators, run to completion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..sources import derived
from ..streaming import operators as S
from ..streaming.erasures import suppress_live
from .core import canon_sql, register
from .oracle_base import with_tables
from .q_views import NOT_IN_COMPLETED


def _activity_stream(m, max_files=1):
    """Activities derived from the events file stream (stream-static join
    with the customer dimension)."""
    class _Streamed:
        def __init__(self, model):
            self.model = model

        def __getitem__(self, name):
            if name == "events":
                return S.read_stream(self.model.spark, self.model.sf_dir, "events", max_files)
            return self.model.tables[name]
    return derived.user_activities(_Streamed(m)), derived.gdpr_audit_log(_Streamed(m))


@register("stream_suppress", with_tables("px_user_activities", "px_erasure_requests") + f"""
SELECT event_id, user_email FROM px_user_activities WHERE user_email NOT IN {NOT_IN_COMPLETED}""")
def stream_suppress(m):
    """Streaming activities with erased subjects suppressed (= rap_erased)."""
    acts, _ = _activity_stream(m)
    return S.run_batches(acts.select("event_id", "user_email"), "stream_suppress",
                         lambda batch: S.suppress_erased(batch, "user_email", m["erasure_requests"]))


#: Windows that end before the newest event less a day are final.
CLOSED_SQL = """event_timestamp < date_trunc('day', (SELECT max(event_timestamp) FROM px_audit_log) - INTERVAL 1 DAY)"""


@register("stream_audit_daily", canon_sql(with_tables("px_audit_log") + """
SELECT CAST(event_timestamp AS DATE) AS audit_date, event_type, count(*) AS event_count,
       min(event_timestamp) AS first_event, max(event_timestamp) AS last_event, TRUE AS distinct_within_events
FROM px_audit_log GROUP BY ALL""", ["audit_date", "first_event", "last_event"]))
def stream_audit_daily(m):
    """Daily audit summary of a stream: every micro-batch stores a day's counts and distinct
    sketches, which are united when the summary is read (no distinct users or customers than events,
    up to the sketches' error; how close they are is tested)."""
    _, audit = _activity_stream(m)
    days = S.audit_days(S.run_batches(audit, "stream_audit_daily", S.audit_day_sketches))
    return days.select("audit_date", "event_type", "event_count", "first_event", "last_event",
                       (F.greatest("unique_customers", "unique_users") <= F.ceil(1.1 * F.col("event_count"))).alias("distinct_within_events"))


@register("stream_audit_daily_exact", canon_sql(with_tables("px_audit_log") + f"""
SELECT CAST(event_timestamp AS DATE) AS audit_date, event_type, count(*) AS event_count,
       count(DISTINCT customer_email) AS unique_customers, count(DISTINCT user_name) AS unique_users,
       min(event_timestamp) AS first_event, max(event_timestamp) AS last_event
FROM px_audit_log WHERE {CLOSED_SQL} GROUP BY ALL""", ["audit_date", "first_event", "last_event"]))
def stream_audit_daily_exact(m):
    """The same with exact distinct counts: the stream counts per (day, type,
    customer, user), a batch aggregate adds the levels up."""
    _, audit = _activity_stream(m)
    return S.audit_daily_exact(S.run_to_table(S.audit_daily_counts(audit), "stream_audit_exact"))


#: Every eleventh audit event with an e-mail stands for a completed erasure, as requests date from other years.
COMPLETION_SQL = """SELECT customer_email, event_timestamp AS completed_at FROM px_audit_log
WHERE CAST(substr(audit_id, 5) AS BIGINT) % 11 = 0 AND customer_email IS NOT NULL"""


@register("stream_suppress_live", with_tables("px_user_activities", "px_audit_log", completions=COMPLETION_SQL) + """
SELECT a.event_id, a.user_email FROM px_user_activities a
WHERE NOT EXISTS (SELECT 1 FROM completions c WHERE c.customer_email = a.user_email
                  AND c.completed_at <= a.event_timestamp AND a.event_timestamp < c.completed_at + INTERVAL 7 DAY)""")
def stream_suppress_live(m):
    """Streaming activities without those of seven days from an erasure of their subject on, the
    erasures being a stream too.  All files are one micro-batch: later ones are tested."""
    acts, audit = _activity_stream(m, 1_000_000)
    done = audit.where(F.substring("audit_id", 5, 30).cast("long") % 11 == 0).select("customer_email", "event_timestamp")
    kept, _ = suppress_live(acts.select("event_id", "user_email", "event_timestamp"), "user_email", "event_timestamp",
                            done, "customer_email", "event_timestamp", dt.timedelta(days=7), dt.timedelta(days=1))
    return kept.select("event_id", "user_email")
