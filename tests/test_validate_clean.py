import unicodedata

import pytest
from pyspark.sql import functions as F
from rows import at, landing

from threadloom.functions.text import nfkc
from threadloom.operators import clean, validate


def report(df):
    return validate.validation_report(validate.check_rows(df)).first().asDict()


def failures(df):
    return {r.tweet_id: r.failures for r in validate.quarantine(validate.check_rows(df)).collect()}


def test_valid_row_passes(spark):
    found = report(landing(spark, {}))
    assert (found["rows_in"], found["rows_valid"], found["rows_rejected"]) == (1, 1, 0)
    assert found["broken_response_link_rate"] == 0.0


@pytest.mark.parametrize("hot", [False, True])
def test_all_rows_of_a_repeated_id_fail(spark, request, hot):
    if hot:
        request.getfixturevalue("skewed")
    df = landing(spark, *([{"tweet_id": 1}] * 9), {"tweet_id": 2, "text": "x"}, {"tweet_id": None})
    checked = validate.check_rows(df)
    assert [r.tweet_id for r in validate.valid_rows(checked).collect()] == [2]
    assert validate.quarantine(checked).count() == 10


def test_every_hard_check_is_named(spark):
    found = failures(
        landing(
            spark,
            {"tweet_id": -1},
            {"tweet_id": 2, "author_id": "", "text": ""},
            {"tweet_id": 3, "created_at": at(year=2999)},
            {"tweet_id": 4, "created_at": at(year=1999)},
            {"tweet_id": 5, "text": None},
            {"tweet_id": 6, "text": "  "},
        )
    )
    assert found == {
        -1: ["tweet_id is negative"],
        2: ["author_id is empty", "text is empty"],
        3: ["created_at is too late"],
        4: ["created_at is too early"],
        5: ["text is null"],
    }


def test_window_ends_are_valid(spark):
    from datetime import datetime, timezone

    df = landing(
        spark,
        {"tweet_id": 1, "created_at": datetime(2006, 3, 21, tzinfo=timezone.utc)},
        {"tweet_id": 2, "created_at": datetime(2020, 1, 1, tzinfo=timezone.utc)},
        {"tweet_id": 3, "created_at": datetime(2020, 1, 1, 0, 0, 1, tzinfo=timezone.utc)},
    )
    assert set(failures(df)) == {3}


def test_links_and_pairs_are_only_counted(spark):
    df = landing(
        spark,
        {"tweet_id": 1, "in_response_to_tweet_id": 999},
        {"tweet_id": 2, "in_response_to_tweet_id": 1},
        {"tweet_id": 3, "in_response_to_tweet_id": 999},
        {"tweet_id": 4, "text": ""},
        {"tweet_id": 5, "in_response_to_tweet_id": 4, "author_id": "other"},
    )
    found = report(df)
    assert found["rows_valid"] == 4
    assert found["broken_response_links"] == 3  # a rejected row is no parent
    assert found["broken_response_link_rate"] == 0.75
    assert found["duplicate_author_text_pairs"] == 2


def test_pairs_with_hot_copies(spark, skewed):
    df = landing(spark, *({"tweet_id": i, "text": "same" if i < 20 else f"text {i}"} for i in range(30)))
    assert report(df)["duplicate_author_text_pairs"] == 19


def test_schema_problems(spark):
    df = landing(spark, {})
    assert validate.schema_problems(df) == []
    odd = df.drop("text").withColumn("tweet_id", df.tweet_id.cast("int")).withColumn("more", df.inbound)
    assert validate.schema_problems(odd) == [
        "missing column text", "unexpected column more", "column tweet_id is int, not bigint",
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("many   blanks\n\tat once", "many blanks at once"),
        ("café", "café"),
        ("  hi   there  ", "hi there"),
        ("a  b\x1cc　d", "a b c d"),
        ("ﬁne Ａ", "fine A"),
        (" \n\t ", None),
        (None, None),
    ],
)
def test_text_is_normalised(spark, text, expected):
    rows = clean.kept_rows(clean.with_clean_text(landing(spark, {"text": text}))).collect()
    assert [r.text_clean for r in rows] == ([] if expected is None else [expected])
    assert all(r.text == text for r in rows)


def test_cleaning_report(spark):
    df = landing(spark, {"tweet_id": 1}, {"tweet_id": 2, "text": "  \n"}, {"tweet_id": 3, "author_id": None})
    assert clean.cleaning_report(clean.with_clean_text(df)).first().asDict() == {
        "rows_in": 3, "rows_out": 2, "rows_dropped_empty_after_cleaning": 1,
        "unexpected_nulls_in_required_columns": 1,
    }
    assert clean.null_cells(df).first()[0] == 1


def test_nfkc_equals_the_standard(spark):
    texts = ["plain", "", None, "e\u0301t\u00e9", "\ufb01rst \u2116 \uff15", "\u1e9b\u0323", "\uac00\u1100\u1161", "a\u0315\u0300", "\u00bd\u2460"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.n for r in df.select("i", nfkc(F.col("t")).alias("n")).collect()}
    assert found == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
