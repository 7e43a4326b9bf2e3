"""Plans and the registered queries (QUERIES) with their SQL (SQL)."""

from furrow.plans import report_queries, shape_queries  # noqa: F401  (they register their queries)
from furrow.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
