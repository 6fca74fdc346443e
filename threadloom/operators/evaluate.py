"""Scores of checked replies and their summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.constants import MIN_REPLY_LENGTH
from threadloom.functions.text import stripped
from threadloom.functions.vectors import cosine
from threadloom.operators.embed import embed

SUMMARY_FLAGS = {
    "link_redaction_rate": "link_redacted",
    "mention_redaction_rate": "mention_redacted",
    "completed_action_claim_rate": "completed_action_claimed",
    "ticket_severity_signal_rate": "ticket_severity_signaled",
    "escalation_rate": "needs_human_escalation",
}


def with_vectors(responses: DataFrame, encoder, key: str = "ticket_id") -> DataFrame:
    """Adds ``reply_vector`` and ``resolution_vectors`` by embedding the texts.

    A response has top-k examples, so regrouping them gathers k vectors a row.
    """
    examples = responses.select(key, F.explode("retrieved_examples").alias("_example")).select(
        key, F.col("_example.resolution_text").alias("resolution_text")
    )
    resolutions = embed(examples, "resolution_text", encoder, "_vector").groupBy(key).agg(
        F.collect_list("_vector").alias("resolution_vectors")
    )
    return embed(responses, "reply", encoder, "reply_vector").join(resolutions, key, "left")


def score_responses(responses: DataFrame) -> DataFrame:
    """Per reply: length, citations, flags, likeness to the retrieved replies.

    Needs ``reply_vector`` and ``resolution_vectors``, the vectors of the reply
    and of the retrieved resolutions. Rows stay where they are.
    """
    likeness = F.transform("resolution_vectors", lambda v: cosine(F.col("reply_vector"), v))
    kept = [
        c
        for c in responses.columns
        if c not in ("reply_vector", "resolution_vectors", "cited_ticket_ids", "hallucinated_citations",
                     "retrieved_examples", "generation_model")
    ]
    total = F.aggregate("_likeness", F.lit(0.0), lambda total, value: total + value)
    return responses.withColumn("_likeness", likeness).select(
        *kept,
        F.char_length("reply").alias("reply_length"),
        (F.char_length(stripped(F.col("reply"))) >= MIN_REPLY_LENGTH).alias("reply_nonempty"),
        F.size("cited_ticket_ids").alias("num_citations"),
        F.size("hallucinated_citations").alias("num_hallucinated_citations"),
        F.array_max("_likeness").alias("max_groundedness_similarity"),
        F.try_divide(total, F.size("_likeness")).alias("mean_groundedness_similarity"),
    )


def summarize(scores: DataFrame) -> DataFrame:
    """Rates over all scored replies, as one row; NULL rates for no replies."""
    rates = {"hallucination_rate": F.col("num_hallucinated_citations") > 0}
    rates |= {name: F.col(flag) for name, flag in SUMMARY_FLAGS.items()}
    return scores.agg(
        F.count(F.lit(1)).alias("num_queries"),
        *(F.avg(test.cast("double")).alias(name) for name, test in rates.items()),
        F.avg("mean_groundedness_similarity").alias("mean_groundedness_similarity"),
        F.count_if(~F.col("reply_nonempty")).alias("empty_or_short_replies"),
    )


def per_query(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of the replies to the queries of a test set (column ``query``)."""
    return scores.join(queries.select("query").distinct(), "query", "left_semi")


def flag_rates(runs: DataFrame, flag: str, *by: str) -> DataFrame:
    """How often a flag was raised over repeated runs, per group."""
    raised = F.count_if(F.col(flag))
    return runs.groupBy(*by).agg(
        raised.alias("raised"),
        F.count(F.lit(1)).alias("runs"),
        F.avg(F.col(flag).cast("double")).alias("rate"),
    )
