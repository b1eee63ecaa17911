"""All registered queries of the library."""

from foliant.plans import corpus_queries, detail_queries, fixture_queries, store_queries  # noqa: F401  they register themselves
from foliant.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
