"""All queries over the driver tables, and their oracles."""

from . import queries_accounting, queries_drift, queries_joins, queries_more, queries_recovery, queries_scalars, queries_state  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
