"""One row per thread, and one feature row per customer ticket."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranks import exact_median
from threadloom.operators.threads import reply_roots, with_roots
from threadloom.schemas import TICKET_FEATURES

_THIN = ("tweet_id", "author_id", "inbound", "created_at", "in_response_to_tweet_id")


def earliest(value: str) -> Column:
    """Smallest by time then id among brand rows with a value; no time is last."""
    row = F.struct(
        F.col("created_at").isNull().alias("undated"), "created_at", "tweet_id", F.col(value).alias("value")
    )
    return F.min(F.when(~F.col("inbound") & F.col(value).isNotNull(), row))["value"]


def thread_table(rooted: DataFrame) -> DataFrame:
    """Counts and first brand reply per thread. Needs no text.

    Every aggregate combines map-side, so a thread of any size adds one row
    per map task to the shuffle.
    """
    return rooted.groupBy("thread_root_id").agg(
        F.count(F.lit(1)).alias("num_messages"),
        F.count_if("inbound").alias("num_customer_messages"),
        F.min(F.when(~F.col("inbound"), F.col("created_at"))).alias("first_brand_response_at"),
        earliest("author_id").alias("brand_id"),
    )


def words(text: Column) -> Column:
    """Number of blank-separated words of cleaned text."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def tickets_from_threads(tweets: DataFrame, threads: DataFrame) -> DataFrame:
    """Feature rows of threads whose first row is a customer's.

    Text joins in last and only for customer rows. Ids are unique on both
    sides, so no key is hot.
    """
    openers = tweets.where("inbound").select("tweet_id", "author_id", "created_at", "text_clean")
    brand_messages = F.col("num_messages") - F.col("num_customer_messages")
    text = F.col("text_clean")
    return openers.join(threads, F.col("tweet_id") == F.col("thread_root_id")).select(
        F.col("tweet_id").alias("ticket_id"),
        F.col("author_id").alias("customer_id"),
        "brand_id",
        F.col("created_at").alias("opened_at"),
        text.alias("text"),
        F.char_length(text).alias("text_length"),
        words(text).alias("word_count"),
        "num_messages",
        "num_customer_messages",
        brand_messages.alias("num_brand_messages"),
        seconds_between(F.col("created_at"), F.col("first_brand_response_at")).alias("first_response_seconds"),
        (brand_messages > 0).alias("resolved"),
    )


def build_ticket_features(tweets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Cleaned tweets to ticket feature rows.

    ``roots`` is the result of ``reply_roots`` where it has been kept.
    """
    roots = reply_roots(tweets) if roots is None else roots
    threads = thread_table(with_roots(tweets.select(*_THIN), roots))
    return tickets_from_threads(tweets, threads).select(*TICKET_FEATURES.fieldNames())


def feature_report(tweets: DataFrame, roots: DataFrame, tickets: DataFrame) -> DataFrame:
    """Sizes and first-response times, as one row.

    A row is a thread's first row exactly when it has no entry in ``roots`` or
    is its own root, so threads are counted without a distinct.
    """
    replies = roots.where(F.col("tweet_id") != F.col("thread_root_id")).agg(F.count(F.lit(1)))
    return (
        tweets.agg(F.count(F.lit(1)).alias("total_tweets"))
        .withColumn(
            "_tickets",
            tickets.agg(
                F.struct(
                    F.count(F.lit(1)).alias("n"),
                    F.count_if("resolved").alias("resolved"),
                    F.max("first_response_seconds").alias("slowest"),
                )
            ).scalar(),
        )
        .select(
            "total_tweets",
            (F.col("total_tweets") - replies.scalar()).alias("total_threads"),
            F.col("_tickets.n").alias("tickets_extracted"),
            F.col("_tickets.resolved").alias("tickets_with_brand_response"),
            exact_median(tickets, "first_response_seconds").scalar().alias("median_first_response_seconds"),
            F.col("_tickets.slowest").alias("max_first_response_seconds"),
        )
    )
