import csv
import gzip
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.functions import parsing as P
from threadloom.operators import ingest
from threadloom.sources import csv as source
from threadloom.sources.csv import read_raw_csv
from threadloom.sources.tables import read_table, scratch_path
from threadloom.streaming import arrivals

CSV = """tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
51,shop_desk,False,Mon Mar 06 08:15:30 +0000 2017,Parcels leave at noon,52,
52,ana,True,Mon Mar 06 08:20:00 +0000 2017,good to know,"53,54",51
53,ana,True,last Tuesday,no date here,,51
"""
HEADER = CSV.splitlines()[0]
STAMP = "Thu May 04 19:42:11 +0000 2017"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, lenient, strict",
    [
        ("1", 1, 1), (" 1 ", 1, 1), ("+1", 1, 1), ("-1", -1, -1), ("007", 7, 7), ("1_000", 1000, 1000),
        ("1.0", 1, None), ("1_0.00", 10, None), ("1.", None, None), ("1.5", None, None), ("1e3", None, None),
        ("", None, None), ("_1", None, None), ("1__0", None, None), ("--1", None, None), ("+ 1", None, None),
        ("99999999999999999999", None, None), (" 5", 5, 5),
    ],
)
def test_integers(spark, raw, lenient, strict):
    assert one(spark, P.tweet_id, raw) == lenient
    assert one(spark, P.strict_integer, raw) == strict


@pytest.mark.parametrize(
    "raw, seconds",
    [
        (STAMP, 1493926931),
        ("wed may 3 2:1:7 +0530 2017", 1493757067),
        ("Mon May 04 19:42:11 -0800 2017", 1493926931 + 8 * 3600),
        ("Tue May 04 19:42:11 Z 2017", 1493926931),
        ("Tue May 04 19:42:11 +00:00 2017", 1493926931),
        ("Tue May 04 19:42:11 +053015 2017", 1493926931 - 19815),
        ("Tue May 04 19:42:11 +2359 2017", 1493926931 - 86340),
        ("Tue Feb 30 19:42:11 +0000 2017", None),
        ("Tue May 04 24:42:11 +0000 2017", None),
        ("Tue May 04 19:42:60 +0000 2017", None),
        ("Tuesday May 04 19:42:11 +0000 2017", None),
        ("Xyz May 04 19:42:11 +0000 2017", None),
        (" " + STAMP, None), (STAMP + " ", None), ("not-a-real-date", None), ("", None),
    ],
)
def test_dates(spark, raw, seconds):
    assert one(spark, lambda c: F.unix_seconds(P.created_at(c)), raw) == seconds


def test_dates_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, lambda c: F.unix_seconds(P.created_at(c)), STAMP) == 1493926931
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("raw, expected", [("True", True), (" TRUE\t", True), ("yes", False), ("", False)])
def test_inbound(spark, raw, expected):
    assert one(spark, P.inbound, raw) is expected


def test_valid_rows_are_written_and_bad_ones_counted(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(CSV)
    summary = ingest.ingest(spark, str(tmp_path / "raw.csv"), str(tmp_path / "landing"))
    assert summary.first().asDict() == {"rows_read": 3, "rows_written": 2, "rows_rejected": 1}
    rows = {r.tweet_id: r for r in read_table(spark, str(tmp_path / "landing")).collect()}
    assert set(rows) == {51, 52}
    assert rows[51].inbound is False and rows[51].in_response_to_tweet_id is None
    assert rows[51].response_tweet_id == [52]
    assert rows[52].response_tweet_id == [53, 54] and rows[52].in_response_to_tweet_id == 51
    assert rows[51].created_at == datetime(2017, 3, 6, 8, 15, 30)


def test_csv_keeps_quotes_line_ends_and_empty_fields(spark, tmp_path):
    body = f'7,,no,{STAMP}," two\nlines, ""quoted"" ",,\n'
    (tmp_path / "raw.csv").write_text(HEADER + "\n" + body)
    row = read_raw_csv(spark, str(tmp_path / "raw.csv")).first()
    assert row.text == ' two\nlines, "quoted" '
    assert row.author_id == "" and row.response_tweet_id == ""


def test_csv_columns_go_by_name(spark, tmp_path):
    names = HEADER.split(",")
    (tmp_path / "raw.csv").write_text(",".join(reversed(names)) + ",extra\n" + f",,hi,{STAMP},True,bob,9,x\n")
    row = read_raw_csv(spark, str(tmp_path / "raw.csv")).first()
    assert (row.tweet_id, row.author_id, row.text) == ("9", "bob", "hi")
    (tmp_path / "short.csv").write_text("tweet_id,text\n1,hi\n")
    with pytest.raises(ValueError, match="author_id"):
        read_raw_csv(spark, str(tmp_path / "short.csv"))


def test_files_with_other_column_orders(spark, tmp_path):
    names = HEADER.split(",")
    first = dict(zip(names, ("1", "bob", "True", STAMP, "first", "", ""), strict=True))
    second = dict(zip(names, ("2", "eve", "True", STAMP, "second, with\ntwo lines", "", "1"), strict=True))
    (tmp_path / "a.csv").write_text(HEADER + "\n" + ",".join(first.values()) + "\n")
    turned = ["text", "note", *(n for n in reversed(names) if n != "text")]
    (tmp_path / "b.csv").write_text(",".join(turned) + "\n" + ",".join(f'"{second.get(n, "x")}"' for n in turned) + "\n")
    rows = {r.tweet_id: r.asDict() for r in read_raw_csv(spark, str(tmp_path)).collect()}
    assert rows == {"1": first, "2": second}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(Session(), "x")


def test_one_bad_part_rejects_the_row_and_is_named(spark):
    raw = spark.createDataFrame(
        [("1", "a", "true", STAMP, "t", "3,", ""), ("1.0", "a", "true", STAMP, "t", "", "1.0"),
         ("x", "", "true", "never", "", "", "")],
        "tweet_id string, author_id string, inbound string, created_at string, text string,"
        " response_tweet_id string, in_response_to_tweet_id string",
    )
    reasons = [r.reject_reasons for r in ingest.rejected(ingest.parse_rows(raw)).collect()]
    assert sorted(reasons) == [["in_response_to_tweet_id"], ["response_tweet_id"], ["tweet_id", "created_at"]]


def test_stream_equals_batch(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(3):
        (raw / f"{i}.csv").write_text(CSV)
    args = (str(tmp_path / "landing"), str(tmp_path / "counts"), str(tmp_path / "checkpoint"))
    arrivals.ingest_stream(spark, str(raw), *args, files_per_trigger=1).awaitTermination()
    assert arrivals.running_counts(spark, args[1]).first().asDict() == {
        "rows_read": 9, "rows_written": 6, "rows_rejected": 3,
    }
    assert read_table(spark, args[0]).count() == 6
    # Nothing new: a second run adds no rows.
    arrivals.ingest_stream(spark, str(raw), *args, files_per_trigger=1).awaitTermination()
    assert read_table(spark, args[0]).count() == 6


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(HEADER + "\n")
    summary = ingest.ingest(spark, str(tmp_path / "raw.csv"), str(tmp_path / "landing"))
    assert tuple(summary.first()) == (0, 0, 0)
    assert read_table(spark, str(tmp_path / "landing")).count() == 0


def records(path):
    """Rows as a plain reader gives them."""
    with open(path, newline="", encoding="utf-8-sig") as file:
        rows = list(csv.reader(file))
    return sorted(tuple((row + [""] * 7)[:7]) for row in rows[1:] if row)


def read_back(spark, path, size=None):
    return sorted(map(tuple, read_raw_csv(spark, str(path), size).collect()))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [40, 150, 997])
def test_ranges_of_one_file(spark, tmp_path, size, end):
    """Line ends, commas, doubled quotes and whole ranges inside quotes."""
    pick = random.Random(size)
    lines = [HEADER]
    for i in range(40):
        text = "".join(pick.choices(["word ", "\n", '""', ",", "é日🙂", end, '"",""', " "], k=pick.choice([0, 3, 9, 150])))
        lines.append(f'{i},"a{i}",{"true" if i % 2 else ""},"{STAMP}","{text}",,' if i % 3 else f"{i},b,no,{STAMP},plain,,")
        if i % 7 == 0:
            lines.append("")
    (tmp_path / "raw.csv").write_bytes((end.join(lines) + (end if size > 100 else "")).encode())
    expected = records(tmp_path / "raw.csv")
    assert len(expected) == 40
    assert read_back(spark, tmp_path / "raw.csv", size) == expected
    assert read_back(spark, tmp_path / "raw.csv") == expected


@pytest.mark.parametrize("seed", range(3))
def test_range_states_equal_a_walk_over_the_file(seed):
    """Whether a line ends inside quotes, for stray quotes too, against a walk by character."""
    pick = random.Random(seed)
    for _ in range(2_000):
        line = "".join(pick.choices('",a ', k=pick.randrange(0, 12)))
        for inside in (False, True):
            state = "quoted" if inside else "start"
            for char in line:
                if state == "quoted":
                    state = "quote" if char == '"' else "quoted"
                elif state == "quote" and char == '"':
                    state = "quoted"
                elif char == ",":
                    state = "start"
                else:
                    state = "quoted" if state == "start" and char == '"' else "plain"
            assert source.ends_inside(line, inside) == (state == "quoted")


def test_each_range_is_a_task(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(HEADER + "\n" + "".join(f'{i},bob,True,{STAMP},"two\nlines",,\n' for i in range(100)))
    size = (tmp_path / "raw.csv").stat().st_size
    with source._held_ranges(spark, 300):
        assert source._lines(spark, str(tmp_path / "raw.csv")).rdd.getNumPartitions() == -(-size // 300)
    assert read_back(spark, tmp_path / "raw.csv", 300) == records(tmp_path / "raw.csv")


def test_compressed_files(spark, tmp_path):
    (tmp_path / "raw.csv.gz").write_bytes(gzip.compress(("﻿" + CSV).encode()))
    (tmp_path / "more.csv").write_text(",".join(reversed(HEADER.split(","))) + ",extra\n" + f',,"hi\nthere",{STAMP},True,bob,9,x\n')
    (tmp_path / "none.csv").write_text("")
    rows = read_raw_csv(spark, str(tmp_path), 100).collect()
    assert sorted((r.tweet_id, r.text) for r in rows) == [("51", "Parcels leave at noon"), ("52", "good to know"), ("53", "no date here"), ("9", "hi\nthere")]
    with pytest.raises(ValueError, match="no header"):
        read_raw_csv(spark, str(tmp_path / "none.csv"))


def test_arriving_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text(CSV)
    (tmp_path / "raw" / "b.csv.gz").write_bytes(gzip.compress((",".join(reversed(HEADER.split(","))) + ",extra\n" + f',,"hi\nthere",{STAMP},True,bob,9,x\n').encode()))
    (tmp_path / "raw" / "c.csv").write_text(HEADER + "\n")
    (tmp_path / "raw" / "d.csv").write_text("")
    args = (str(tmp_path / "landing"), str(tmp_path / "counts"), str(tmp_path / "checkpoint"))
    arrivals.ingest_stream(spark, str(tmp_path / "raw"), *args).awaitTermination()
    assert tuple(arrivals.running_counts(spark, args[1]).first()) == (4, 3, 1)
    assert {(r.tweet_id, r.text) for r in read_table(spark, args[0]).collect()} == {(51, "Parcels leave at noon"), (52, "good to know"), (9, "hi\nthere")}
