"""Raw tweet CSV: header names matter, every field is a string, blanks stay.

Files are read in byte ranges, one large file by many tasks. A line end inside
a quoted field belongs to the field, so a task cannot tell by itself whether
its range begins inside one. The first pass therefore finds for each range the
state it ends in, for either state it may begin in. A scan over the ranges of
each file puts these together, and the second pass cuts the records. A record
that goes over the end of its range comes in pieces, which are put together by
themselves; they are at most two a range.

Spark's text source does the reading: any file system and codec it knows will
do. A compressed file is one range.
"""

import csv
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.constants import RAW_COLUMNS
from threadloom.operators.joins import sized_join
from threadloom.sources.tables import materialize

# One record at a time; line ends inside quotes stay as they are.
_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
# From inside a quoted field to the quote that ends it; a doubled quote is one quote.
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
# A task reads about so many bytes of ranges that are shorter.
TASK_BYTES = 16 << 20
# Kinds of rows that the second pass gives: whole records, pieces, and the first line of a file.
WHOLE, HEAD, THROUGH, TAIL, HEADER = range(5)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, given whether it begins inside one.

    A field is quoted if its first character is a quote; other quotes are characters.
    """
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(',"')
            if at < 0:
                return False
            at += 1
        at += 1
    while True:
        rest = _REST.match(line, at)
        if rest is None:
            return True
        at = line.find(',"', rest.end()) + 2
        if at < 2:
            return False


def _runs(frame: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """The lines of a batch by (file, start of the range), in their order."""
    file, start = (frame[name].to_numpy(zero_copy_only=False) for name in ("file", "start"))
    edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(file)], strict=True):
        if low < high:
            yield (int(file[low]), int(start[low])), frame["value"].slice(low, high - low)


def _quoted(lines: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def _states(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State at the end of each range, for both states at its beginning."""
    now: tuple[int, int] | None = None
    ends = [False, True]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "outside": [ends[0]], "inside": [ends[1]]})

    for frame in frames:
        for key, lines in _runs(frame):
            begins = key != now
            if begins and now is not None:
                yield row()
            if begins:
                now, ends = key, [False, True]
            for at in _quoted(lines):
                if at == 0 and begins and key[1] == 0:
                    continue  # the header
                line = lines[at].as_py()
                first = ends_inside(line, ends[0])
                ends = [first, first if ends[0] == ends[1] else ends_inside(line, ends[1])]
    if now is not None:
        yield row()


def _cut(inside: frozenset[int]):
    """Records and pieces of the ranges; ``inside`` has the ranges that begin in a quoted field."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        # Lines of the record that is open, and whether it began in an earlier range.
        held: list[str] = []
        is_open = early = False
        for frame in frames:
            rows: list[tuple[int, int, int, str]] = []
            for key, lines in _runs(frame):
                texts = lines.to_pylist()
                at = 0
                if key != now:
                    if is_open:
                        rows.append((*now, THROUGH if early else TAIL, "\n".join(held)))
                    now, held = key, []
                    is_open = early = hash_of(*key) in inside
                    if key[1] == 0:
                        rows.append((*key, HEADER, texts[0]))
                        at = 1
                for quoted in [*_quoted(lines), len(texts)]:
                    if quoted < at:
                        continue
                    if is_open:
                        held += texts[at:quoted]
                    else:
                        rows += [(*key, WHOLE, text) for text in texts[at:quoted]]
                    at = quoted + 1
                    if quoted == len(texts):
                        break
                    held.append(texts[quoted])
                    is_open = ends_inside(texts[quoted], is_open)
                    if not is_open:
                        rows.append((*key, HEAD if early else WHOLE, "\n".join(held)))
                        held, early = [], False
            if rows:
                yield _batch(rows)
        if is_open:
            yield _batch([(*now, THROUGH if early else TAIL, "\n".join(held))])

    return cut


_CUT_SCHEMA = "file long, start long, kind int, text string"


def _batch(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    file, start, kind, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.int64()), pa.array(start, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.string())],
        ["file", "start", "kind", "text"],
    )


def hash_of(file: int, start: int) -> int:
    """One number for a range; ``file`` is a 64-bit hash already."""
    return (file + start * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def _lines(spark: SparkSession, path: str | list[str], range_bytes: int | None) -> DataFrame:
    """Lines in the order of the file within each range. A line belongs to the range it begins in.

    A task reads short ranges one after another, so many that starting it does not cost more than they do.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    )
    if not range_bytes or range_bytes >= TASK_BYTES:
        return lines
    ranges, slots = lines.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return lines.coalesce(max(1, min(ranges, 2 * slots), ranges * range_bytes // TASK_BYTES))


@contextmanager
def _held_ranges(spark: SparkSession, range_bytes: int | None):
    """Both passes see the same ranges, whatever happens to the cluster in between."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = {name: spark.conf.get(name, None) for name in names}
    slots = 1 if range_bytes else spark.sparkContext.defaultParallelism
    if range_bytes:
        spark.conf.set(names[0], str(range_bytes))
    spark.conf.set(names[1], str(slots))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _begin_inside(states: DataFrame) -> DataFrame:
    """Ranges that begin inside a quoted field.

    Each range keeps the state, turns it round, or ends in one state whatever
    came before. So the state is that of the last range of the third kind, turned
    round as often as the ranges after it do. The windows have one row a range.
    """
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = states.withColumn("_turns", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    ))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), "_turns"))
    known = turns.select(
        "file", "start",
        F.last("_turns").over(earlier).alias("_before"),
        F.last(fixed, ignorenulls=True).over(earlier).alias("_fixed"),
    )
    begun = F.coalesce(F.col("_fixed.state").cast("int"), F.lit(0))
    passed = F.coalesce(F.col("_before"), F.lit(0)) - F.coalesce(F.col("_fixed._turns"), F.lit(0))
    return known.where((begun + passed) % 2 == 1).select("file", "start")


def _whole_records(cut: DataFrame) -> DataFrame:
    """``file`` and ``text`` of all records; pieces go together in the order of their ranges."""
    pieces = cut.where(F.col("kind").isin(HEAD, THROUGH, TAIL))
    in_order = Window.partitionBy("file").orderBy("start", "kind")
    joined = (
        pieces.withColumn("_record", F.count_if(F.col("kind") == TAIL).over(in_order))
        .groupBy("file", "_record")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("_pieces"))
        .select("file", F.array_join(F.col("_pieces.text"), "\n").alias("text"))
    )
    return cut.where(F.col("kind") == WHOLE).select("file", "text").unionByName(joined)


def _fields(record: Column, header: list[str]) -> list[Column]:
    """The seven columns of a record under a header; empty fields are "" and not NULL."""
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    parsed = F.from_csv(F.regexp_replace(record, "\r$", ""), schema, _OPTIONS)
    return [F.coalesce(parsed[f"c{header.index(name)}"], F.lit("")).alias(name) for name in RAW_COLUMNS]


def _parsed(records: DataFrame, lines: list[str], by: str | None) -> DataFrame:
    """Typed by name: ``records`` has ``text`` and, where there are several headers, the header's line in ``by``."""
    parts = []
    for line in lines:
        header = next(csv.reader([line.removeprefix("\ufeff").rstrip("\r")]), [])
        missing = [c for c in RAW_COLUMNS if c not in header]
        if missing:
            raise ValueError(f"raw CSV lacks the columns {missing}; the header is {line!r}")
        mine = records if by is None else records.where(F.col(by) == line)
        parts.append(mine.where(~F.col("text").isin("", "\r")).select(*_fields(F.col("text"), header)))
    return reduce(DataFrame.unionByName, parts)


def read_raw_csv(spark: SparkSession, path: str | list[str], range_bytes: int | None = None) -> DataFrame:
    """All seven columns by header name, in any order; extra columns are ignored.

    Every file goes by its own header, and several headers may occur. Ranges
    are ``range_bytes`` long, by default as Spark would cut the files. The
    records are written to scratch once, in the second pass.
    """
    with _held_ranges(spark, range_bytes):
        lines = _lines(spark, path, range_bytes)
        states = materialize(lines.mapInArrow(_states, "file long, start long, outside boolean, inside boolean"), "csv-ranges")
        # As many numbers as the driver holds ranges of the scan anyway.
        inside = frozenset(hash_of(row["file"], row["start"]) for row in _begin_inside(states).collect())
        cut = materialize(lines.mapInArrow(_cut(inside), _CUT_SCHEMA), "csv-records")
    heads = cut.where(F.col("kind") == HEADER).select(F.col("file").alias("_file"), F.col("text").alias("header"))
    headers = sorted(row["header"] for row in heads.select("header").distinct().collect())
    if not headers:
        raise ValueError(f"raw CSV has no header: {path}")
    records = _whole_records(cut)
    if len(headers) == 1:
        return _parsed(records, headers, None)
    return _parsed(sized_join(records, heads, "file", "_file", spread=F.xxhash64("text")), headers, "header")


def _whole_files(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole files, with the header of each."""
    for frame in frames:
        for text in frame["value"]:
            lines = text.as_py().split("\n")
            if lines[-1] == "":
                lines.pop()
            if not lines:
                continue
            run = pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string()), "file": [0] * len(lines), "start": [0] * len(lines)})
            for batch in _cut(frozenset())(iter([run])):
                kept = batch.filter(pc.not_equal(batch["kind"], HEADER))
                yield pa.RecordBatch.from_arrays([pa.array([lines[0]] * len(kept), pa.string()), kept["text"]], ["header", "text"])


def stream_raw_csv(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    """``header`` and ``text`` of the records of arriving files, in bounded steps.

    An arriving file is read by one task; ``parsed_batch`` types the rows of a step.
    """
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(path, wholetext=True)
        .select("value")
        .mapInArrow(_whole_files, "header string, text string")
    )


def parsed_batch(batch: DataFrame) -> DataFrame:
    """The seven columns of the records of a step, each by the header of its file."""
    headers = sorted(row["header"] for row in batch.select("header").distinct().collect())
    if not headers:
        return batch.select(*(F.col("text").alias(c) for c in RAW_COLUMNS))
    return _parsed(batch, headers, "header")


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Seven string columns as quoted CSV with a header."""
    write_csv(df.select(*RAW_COLUMNS), path)


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .options(header="true", quote='"', escape='"', quoteAll="true")
        .options(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        .csv(path)
    )
