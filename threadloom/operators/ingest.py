"""Raw string rows to typed landing rows, with bad rows kept apart."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadloom.constants import RAW_COLUMNS
from threadloom.functions import parsing as P
from threadloom.schemas import LANDING
from threadloom.sources.csv import read_raw_csv
from threadloom.sources.tables import write_table

_SUMMARY = ("rows_read", "rows_written", "rows_rejected")


def parse_rows(raw: DataFrame) -> DataFrame:
    """Landing columns plus ``reject_reasons``, the names of unreadable fields."""
    parsed = raw.select(
        F.col("in_response_to_tweet_id").alias("_raw_parent"),
        F.inline(
            F.array(
                F.struct(
                    P.tweet_id(F.col("tweet_id")).alias("tweet_id"),
                    F.col("author_id"),
                    P.inbound(F.col("inbound")).alias("inbound"),
                    P.created_at(F.col("created_at")).alias("created_at"),
                    F.col("text"),
                    P.id_list(F.col("response_tweet_id")).alias("response_tweet_id"),
                    P.optional_id(F.col("in_response_to_tweet_id")).alias("in_response_to_tweet_id"),
                )
            )
        ),
    )
    # A generated row is not merged into later filters, so a field is parsed
    # once, and a reason is a look at the result.
    bad = {name: F.col(name).isNull() for name in ("tweet_id", "author_id", "inbound", "created_at", "text")}
    bad["response_tweet_id"] = F.exists("response_tweet_id", lambda part: part.isNull())
    bad["in_response_to_tweet_id"] = (F.col("_raw_parent") != "") & F.col(
        "in_response_to_tweet_id"
    ).isNull()
    named = F.filter(
        F.array(*(F.when(test, F.lit(name)) for name, test in bad.items())), lambda r: r.isNotNull()
    )
    # Rows without a fault, nearly all, skip building the list.
    any_bad = reduce(or_, (F.coalesce(test, F.lit(False)) for test in bad.values()))
    reasons = F.when(any_bad, named).otherwise(F.array().cast("array<string>"))
    return parsed.select(*RAW_COLUMNS, reasons.alias("reject_reasons"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("reject_reasons") == 0).select(*LANDING.fieldNames())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("reject_reasons") > 0)


def _summary_columns() -> list[Column]:
    bad = F.count_if(F.size("reject_reasons") > 0)
    read = F.count(F.lit(1))
    return [read.alias("rows_read"), (read - bad).alias("rows_written"), bad.alias("rows_rejected")]


def ingest_summary(parsed: DataFrame) -> DataFrame:
    return parsed.agg(*_summary_columns())


def ingest(spark: SparkSession, raw_path: str | list[str], landing_path: str) -> DataFrame:
    """Read raw CSV, write the landing table, give the summary row.

    The rows are counted while they are written, so the CSV is read once.
    """
    counts = Observation("ingest")
    parsed = parse_rows(read_raw_csv(spark, raw_path)).observe(counts, *_summary_columns())
    write_table(accepted(parsed), landing_path)
    found = counts.get
    return spark.createDataFrame(
        [tuple(found[name] for name in _SUMMARY)], ", ".join(f"{name} bigint" for name in _SUMMARY)
    )
