"""All registered queries."""

from threadloom.plans import model_queries, reply_queries, ticket_queries  # noqa: F401
from threadloom.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
