"""The registered queries, each next to the SQL that must give the same rows."""

from opinloom.queries import evaluation, exchange, insights, jobs, labelling, models, preparation, text  # noqa: F401
from opinloom.queries.registry import oracle_sql, queries  # noqa: F401
