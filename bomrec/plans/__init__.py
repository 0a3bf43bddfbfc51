"""Plans over the given tables: lenses, the row-to-line plan and the registered queries."""

from bomrec.plans import queries_evaluation, queries_lines, queries_sources, queries_vocabulary  # noqa: F401
from bomrec.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
