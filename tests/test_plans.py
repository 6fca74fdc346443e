"""Properties of physical plans that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import split, threads, tickets, validate
from threadloom.operators.joins import salted_join
from threadloom.plans.flow import Flow
from threadloom.sources.tables import materialize, scratch_path

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def flow(spark):
    return Flow(spark, SF_DIR)


def test_validation_does_not_shuffle_rows(flow):
    """Repeated ids are few and counted, so the rows themselves stay in place."""
    text = plan(validate.valid_rows(flow.checked))
    assert exchanges(text) == 0 and "BroadcastHashJoin" in text and "Window" not in text


def test_thread_aggregates_read_no_text(flow):
    thin = flow.tweets.select("tweet_id", "author_id", "inbound", "created_at", "in_response_to_tweet_id")
    text = plan(tickets.thread_table(threads.with_roots(thin, flow.roots)))
    assert "text" not in "".join(re.findall(r"ReadSchema: struct<[^>]*>", text))


def test_no_window_over_whole_groups(spark, flow):
    """Split and sample end as a comparison in place, without sorting classes."""
    stored = materialize(flow.labeled.select("ticket_id", "category"), "plan-test")
    for df in (split.stratified_split(stored), split.capped_sample(stored, cap=2)):
        text = plan(df)
        assert "Window" not in text and "Sort" not in text and exchanges(text) == 0


def test_salting_splits_a_hot_key(spark, skewed):
    left = spark.range(40).select(F.col("id").alias("row"), F.lit(7).cast("bigint").alias("k"))
    right = spark.createDataFrame([(7, "seven"), (8, "eight")], "key bigint, name string")
    joined = salted_join(left, right, "k", "key", spread=F.col("row"))
    assert joined.count() == 40 and {r.name for r in joined.collect()} == {"seven"}
    assert "_salt" in plan(joined)
    outer = salted_join(left.withColumn("k", F.when(F.col("row") < 5, 7)), right, "k", "key", "left", spread=F.col("row"))
    assert outer.count() == 40 and outer.where("name is null").count() == 35


def test_scratch_goes_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared)


def test_column_pruning_and_pushdown(spark, flow):
    text = plan(flow.landing.select("tweet_id"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("role" not in s and "text" not in s for s in schemas)
