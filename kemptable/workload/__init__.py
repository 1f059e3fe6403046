"""The registered queries and, where SQL can say the same, their SQL.

Each query reads whole tables. Views such as ``events_nulled`` are defined once
as select lists and used by both sides, because the test tables hold no nulls.
"""

from . import cleaning, files, gate, profiling, runs, sketches, streams  # noqa: F401
from .registry import oracle_sql, queries  # noqa: F401
