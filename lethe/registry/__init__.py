"""Query registry: every implemented operator as a Spark query plus, where
SQL can express it, an independent DuckDB oracle statement."""

from .core import ORACLE, QUERIES  # noqa: F401
from . import q_discovery, q_functions, q_reports, q_streaming, q_views, q_workflow  # noqa: F401  (registers)
