"""Resolved tickets paired with the first reply a brand gave."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.tickets import earliest
from threadloom.operators.threads import reply_roots, with_roots


def first_reply_ids(tweets: DataFrame, roots: DataFrame) -> DataFrame:
    """The id of each thread's first brand reply that has text."""
    thin = tweets.select(
        "tweet_id", "inbound", "created_at",
        F.when(F.col("text_clean").isNotNull(), F.col("tweet_id")).alias("reply_id"),
    )
    return (
        with_roots(thin, roots)
        .groupBy("thread_root_id")
        .agg(earliest("reply_id").alias("reply_id"))
        .where(F.col("reply_id").isNotNull())
    )


def build_knowledge_base(
    tweets: DataFrame, labeled: DataFrame, roots: DataFrame | None = None
) -> DataFrame:
    """Tickets with a reply: message and resolution text.

    Replies are chosen by id; text joins in for the chosen ones only.
    """
    roots = reply_roots(tweets) if roots is None else roots
    replies = tweets.where(~F.col("inbound")).select(
        F.col("tweet_id").alias("_reply"), F.col("text_clean").alias("resolution_text")
    )
    chosen = first_reply_ids(tweets, roots).join(replies, F.col("reply_id") == F.col("_reply"))
    return labeled.join(chosen, F.col("ticket_id") == F.col("thread_root_id")).select(
        "ticket_id", "category", "priority", F.col("text").alias("customer_message"), "resolution_text"
    )


def knowledge_base_report(labeled: DataFrame, knowledge: DataFrame) -> DataFrame:
    found = knowledge.agg(F.count(F.lit(1))).scalar()
    return labeled.agg(F.count(F.lit(1)).alias("tickets_in")).select(
        "tickets_in",
        found.alias("resolutions_found"),
        (F.col("tickets_in") - found).alias("resolutions_missing"),
    )
