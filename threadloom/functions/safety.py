"""Checks on drafted replies and ticket text as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.constants import (
    CLAIM_PATTERNS,
    HANDLE_MARK,
    HANDLE_PATTERN,
    LINK_MARK,
    LINK_PATTERN,
    SEVERITY_PATTERNS,
)
from threadloom.functions.text import regex


def without_links(reply: Column) -> Column:
    return F.regexp_replace(reply, regex(LINK_PATTERN), LINK_MARK)


def without_handles(reply: Column) -> Column:
    return F.regexp_replace(reply, regex(HANDLE_PATTERN), HANDLE_MARK)


def claims_completed_action(reply: Column) -> Column:
    return reply.rlike("(?iU)" + "|".join(CLAIM_PATTERNS))


def signals_severity(ticket_text: Column) -> Column:
    return ticket_text.rlike("(?iU)" + "|".join(SEVERITY_PATTERNS))


def verified_citations(cited: Column, retrieved_ids: Column) -> Column:
    """Cited ids that were retrieved; order and repeats are kept."""
    return F.filter(cited, lambda ticket: F.array_contains(retrieved_ids, ticket))


def unverified_citations(cited: Column, retrieved_ids: Column) -> Column:
    return F.filter(cited, lambda ticket: ~F.array_contains(retrieved_ids, ticket))
