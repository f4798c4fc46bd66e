"""All registered queries and their SQL."""

from soundframe.plans import signals, upkeep  # noqa: F401
from soundframe.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
