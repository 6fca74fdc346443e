"""Reply threads: the top of every reply chain, by pointer doubling.

Each row points at its parent. A round replaces every pointer by the pointer
of the row it points at, so reach doubles and a chain of depth d is done in
about log2(d) rounds, each a join of the rows still open. Rows that reached a
top are left out of later rounds. Every round is written to shared storage:
the plan stays short and a lost executor costs no earlier round.

Rows whose replies run in a circle have no top. Their thread is named after
the lowest id on the circle, whatever the row order. Every row carries the
lowest id of its walk so far, itself left out; a row that finds itself there
has gone round its circle and is the lowest of it. From then on it is a top, so
a circle ends after log2 of its own length, whatever other circles there are.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.joins import fits_broadcast, salted_join
from threadloom.sources.tables import materialize_counted


def _looked_up(rows: DataFrame, table: DataFrame, key: str, how: str, bound: int) -> DataFrame:
    """``rows`` with the row of ``table`` at their key. Neither has more rows than ``bound``,
    and a table that short is broadcast; beyond that, hot keys are salted."""
    if fits_broadcast(rows, bound):
        return rows.join(F.broadcast(table), F.col(key) == F.col("at"), how)
    return salted_join(rows, table, key, "at", how, spread=F.col("tweet_id"), rows=bound)


def _first_step(links: DataFrame, rows: int) -> DataFrame:
    """Rows with a parent in the table; done when that parent starts a thread.

    Rows left out have no parent, reply to themselves or to a missing row, and
    are tops.
    """
    replies = links.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("tweet_id")))
    parents = links.select(F.col("tweet_id").alias("at"), F.col("parent").alias("grand"))
    return _looked_up(replies, parents, "parent", "inner", rows).select(
        "tweet_id",
        F.col("parent").alias("pointer"),
        F.col("parent").alias("low"),
        (F.col("grand").isNull() | (F.col("grand") == F.col("at"))).alias("done"),
    )


def _next_step(open_rows: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """Move the pointers of open rows. A pointer not in ``known`` is a top.

    Only rows that some open pointer points at are looked up: finished rows
    are most of the table and go no further than this test.
    """
    wanted = open_rows.select(F.col("pointer").alias("wanted"))
    wanted = F.broadcast(wanted) if fits_broadcast(open_rows, rows) else wanted.distinct()
    lookup = known.join(wanted, F.col("tweet_id") == F.col("wanted"), "left_semi").select(
        F.col("tweet_id").alias("at"), F.col("pointer").alias("next"), F.col("low").alias("next_low"), F.col("done").alias("next_done")
    )
    return _looked_up(open_rows.drop("done"), lookup, "pointer", "left", rows).select(
        "tweet_id",
        F.coalesce("next", "pointer").alias("pointer"),
        F.least("low", "next_low").alias("low"),
        F.coalesce("next_done", F.lit(True)).alias("done"),
    )


def _closed_circles(open_rows: DataFrame, rows: int) -> DataFrame:
    """The open rows, done where the lowest id of their walk is that of a circle.

    Tails that still see a lower id of their own find the circle through their pointer in a later round.
    """
    lowest = open_rows.where("low = tweet_id").select(F.col("tweet_id").alias("at"))
    return _looked_up(open_rows, lowest, "low", "left", rows).select(
        "tweet_id", F.coalesce("at", "pointer").alias("pointer"), "low", F.col("at").isNotNull().alias("done")
    )


def _store(step: DataFrame) -> tuple[DataFrame, int, int]:
    """The step written out, how many of its rows are open, and how many of those are the lowest of a circle."""
    stored, found = materialize_counted(
        step, "thread-step", open=F.count_if(~F.col("done")), lowest=F.count_if(~F.col("done") & (F.col("low") == F.col("tweet_id")))
    )
    return stored, found["open"], found["lowest"]


def reply_roots(tweets: DataFrame) -> DataFrame:
    """Columns tweet_id and thread_root_id, for rows that are not tops themselves.

    ``tweets`` is a stored table with unique tweet_id, as cleaning leaves it;
    two of its columns are read.
    """
    links = tweets.select("tweet_id", F.col("in_response_to_tweet_id").alias("parent"))
    step, left, _ = _store(_first_step(links, links.count()))
    finished, still_open = step.where("done"), step.where("not done")
    while left:
        step, rest, lowest = _store(_next_step(still_open, finished.unionByName(still_open), left))
        finished, still_open, left = finished.unionByName(step.where("done")), step.where("not done"), rest
        if lowest:
            step, left, _ = _store(_closed_circles(still_open, left))
            finished, still_open = finished.unionByName(step.where("done")), step.where("not done")
    return finished.select("tweet_id", F.col("pointer").alias("thread_root_id"))


def with_roots(tweets: DataFrame, roots: DataFrame) -> DataFrame:
    """``tweets`` plus thread_root_id; a row without an entry is a top."""
    return tweets.join(roots, "tweet_id", "left").withColumn(
        "thread_root_id", F.coalesce("thread_root_id", "tweet_id")
    )


def thread_roots(tweets: DataFrame) -> DataFrame:
    """tweet_id and thread_root_id of every row."""
    return with_roots(tweets.select("tweet_id"), reply_roots(tweets))
