"""Small hand-made tables."""

from datetime import datetime, timezone

from threadloom.schemas import LANDING, TWEETS

NOON = datetime(2017, 10, 31, 12, 0, 0, tzinfo=timezone.utc)


def at(hour=0, minute=0, second=0, year=2017):
    return datetime(year, 10, 31, hour, minute, second, tzinfo=timezone.utc)


def landing(spark, *rows):
    base = {
        "tweet_id": 1, "author_id": "shop_desk", "inbound": False, "created_at": at(), "text": "we are open today",
        "response_tweet_id": None, "in_response_to_tweet_id": None,
    }
    return spark.createDataFrame([tuple({**base, **r}[c] for c in LANDING.fieldNames()) for r in rows], LANDING)


def tweets(spark, *rows):
    base = {
        "tweet_id": 1, "author_id": "ana", "inbound": True, "created_at": at(), "text": "where do I start",
        "response_tweet_id": None, "in_response_to_tweet_id": None, "text_clean": "where do I start",
    }
    return spark.createDataFrame([tuple({**base, **r}[c] for c in TWEETS.fieldNames()) for r in rows], TWEETS)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "tweet_id bigint, in_response_to_tweet_id bigint")


def as_dict(df):
    return {row[0]: row[1] for row in df.collect()}
