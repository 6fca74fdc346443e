"""Hard checks that drop rows and soft metrics that only count."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.constants import MAX_VALID_DATE, MIN_VALID_DATE, NULLABLE_COLUMNS
from threadloom.operators.joins import sized_join
from threadloom.schemas import LANDING

_REQUIRED = [c for c in LANDING.fieldNames() if c not in NULLABLE_COLUMNS]


def schema_problems(df: DataFrame) -> list[str]:
    """Missing, extra or mistyped columns. These concern the table, not its rows."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    expected = {f.name: f.dataType.simpleString() for f in LANDING}
    problems = [f"missing column {c}" for c in expected if c not in found]
    problems += [f"unexpected column {c}" for c in found if c not in expected]
    problems += [
        f"column {c} is {found[c]}, not {expected[c]}"
        for c in expected
        if c in found and found[c] != expected[c]
    ]
    return problems


def _utc(text: str):
    return F.lit(text + " UTC").cast("timestamp")


def row_failures() -> dict:
    """Name and test of each check that a row can fail by itself."""
    checks = {f"{c} is null": F.col(c).isNull() for c in _REQUIRED}
    checks["tweet_id is negative"] = F.col("tweet_id") < 0
    checks["author_id is empty"] = F.col("author_id") == ""
    checks["text is empty"] = F.col("text") == ""
    checks["created_at is too early"] = F.col("created_at") < _utc(MIN_VALID_DATE)
    checks["created_at is too late"] = F.col("created_at") > _utc(MAX_VALID_DATE)
    return checks


def check_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``failures``, the names of all hard checks each row fails.

    All rows of a repeated id fail. Repeated ids are found from the id column
    alone and joined back by broadcast when they are few, so wide rows are not
    shuffled.
    """
    repeated = (
        df.where(F.col("tweet_id").isNotNull())
        .groupBy(F.col("tweet_id").alias("_repeated"))
        .count()
        .where(F.col("count") > 1)
        .select("_repeated")
    )
    joined = sized_join(
        df, repeated, "tweet_id", "_repeated", "left", F.xxhash64("tweet_id", "author_id", "created_at", "text")
    )
    checks = {"tweet_id is not unique": F.col("_repeated").isNotNull(), **row_failures()}
    named = F.filter(
        F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())), lambda name: name.isNotNull()
    )
    # Rows without a fault, nearly all, skip building the list.
    any_failure = reduce(or_, (F.coalesce(test, F.lit(False)) for test in checks.values()))
    failures = F.when(any_failure, named).otherwise(F.array().cast("array<string>"))
    return joined.select(*df.columns, failures.alias("failures"))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("failures") == 0).drop("failures")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("failures") > 0)


def broken_links(valid: DataFrame) -> DataFrame:
    """Reply links whose parent is not a valid row: links, broken ones, rate."""
    per_parent = (
        valid.where(F.col("in_response_to_tweet_id").isNotNull())
        .groupBy(F.col("in_response_to_tweet_id").alias("_parent"))
        .agg(F.count(F.lit(1)).alias("_links"))
    )
    # One row per parent on the left, one per id on the right: no key is hot.
    matched = per_parent.join(
        valid.select("tweet_id"), F.col("_parent") == F.col("tweet_id"), "left"
    )
    links = F.coalesce(F.sum("_links"), F.lit(0))
    broken = F.coalesce(F.sum(F.when(F.col("tweet_id").isNull(), F.col("_links"))), F.lit(0))
    return matched.agg(links.alias("links"), broken.alias("broken_response_links")).withColumn(
        "broken_response_link_rate",
        F.coalesce(F.round(F.try_divide("broken_response_links", "links"), 4), F.lit(0.0)),
    )


def duplicate_pairs(valid: DataFrame) -> DataFrame:
    """Rows after the first of each (author_id, text) pair, as one number.

    A 64-bit hash finds the rows that may have a twin; only those are grouped
    by the pair itself. The count is exact and few texts are shuffled.
    """
    hashed = valid.select(
        "tweet_id", "author_id", "text", F.xxhash64("author_id", "text").alias("_hash")
    )
    suspects = (
        hashed.groupBy(F.col("_hash").alias("_suspect"))
        .count()
        .where(F.col("count") > 1)
        .select("_suspect")
    )
    pairs = (
        sized_join(hashed, suspects, "_hash", "_suspect", spread=F.col("tweet_id"))
        .groupBy("author_id", "text")
        .count()
    )
    return pairs.agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_author_text_pairs")
    )


def validation_report(checked: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """One row: sizes, broken links and repeated pairs.

    ``valid`` is the table of valid rows where it has been written.
    """
    valid = valid_rows(checked) if valid is None else valid
    passed = F.count_if(F.size("failures") == 0)
    return (
        checked.agg(
            F.count(F.lit(1)).alias("rows_in"),
            passed.alias("rows_valid"),
            (F.count(F.lit(1)) - passed).alias("rows_rejected"),
        )
        .withColumn("_links", broken_links(valid).select(F.struct("*")).scalar())
        .select(
            "rows_in",
            "rows_valid",
            "rows_rejected",
            "_links.broken_response_links",
            "_links.broken_response_link_rate",
            duplicate_pairs(valid).scalar().alias("duplicate_author_text_pairs"),
        )
    )
