"""Triage of tickets: predicted labels and the checked draft, one row each."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.constants import MODEL_NAMES
from threadloom.operators.classify import load_model, predict
from threadloom.operators.registry import require_production

AUDIT_COLUMNS = (
    "predicted_category", "predicted_priority", "link_redacted", "mention_redacted",
    "completed_action_claimed", "ticket_severity_signaled", "needs_human_escalation",
)


def accepted_tickets(tickets: DataFrame) -> DataFrame:
    """Tickets with at least one character of text; blanks count."""
    return tickets.where(F.char_length("text") >= 1)


def refused_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("text").isNull() | (F.char_length("text") == 0)).withColumn(
        "error", F.when(F.col("text").isNull(), "text is missing").otherwise("text is empty")
    )


def production_models(ledger: DataFrame, paths: dict[str, str]) -> dict[str, PipelineModel]:
    """Fitted pipelines by target; an error when a target has no production version."""
    for target in paths:
        require_production(ledger, MODEL_NAMES[target])
    return {target: load_model(path) for target, path in paths.items()}


def predict_labels(tickets: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Adds predicted_category and predicted_priority."""
    for target, model in models.items():
        tickets = predict(model, tickets, f"predicted_{target}")
    return tickets


def triage_columns(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """The ten triage columns after the key, from rows that hold text,
    predictions and the checked response."""
    return df.select(
        key,
        F.col("text").alias("ticket_text"),
        "predicted_category",
        "predicted_priority",
        F.col("reply").alias("draft_reply"),
        "cited_ticket_ids",
        "link_redacted",
        "mention_redacted",
        "completed_action_claimed",
        "ticket_severity_signaled",
        "needs_human_escalation",
    )


def triage(predicted: DataFrame, responses: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Predictions with the checked response, one row per ticket.

    A ticket without a usable response stays: it has no reply, raises no flag of
    its own and goes to a person.
    """
    joined = predicted.join(responses, key, "left")
    flags = ("link_redacted", "mention_redacted", "completed_action_claimed", "ticket_severity_signaled")
    filled = {name: F.coalesce(name, F.lit(False)) for name in flags}
    filled["needs_human_escalation"] = F.coalesce("needs_human_escalation", F.lit(True))
    filled["cited_ticket_ids"] = F.coalesce("cited_ticket_ids", F.array().cast("array<string>"))
    return triage_columns(joined.withColumns(filled), key)


def audit(triaged: DataFrame, key: str = "ticket_id") -> DataFrame:
    """What may be logged: the length of the text and the flags, never the text."""
    return triaged.select(key, F.char_length("ticket_text").alias("text_length"), *AUDIT_COLUMNS)
