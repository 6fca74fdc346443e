"""Exact ranks without sorting a whole group in one task.

A row_number over a category would send the category to one task, and one
category can hold most of the rows. Here rows are ordered by a hash of their
id. The hash range is cut into equal buckets, bucket counts give the place of
every bucket, and only the buckets a wanted rank falls in are looked at. One
that still has too many rows is cut by the next bits of the hash, and so on;
the rest are sorted. The result is a key per group and rank; rows are then
compared with that key where they are, without a shuffle.

A median is found in the same way by ranges of the values themselves.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.joins import sized_join
from threadloom.sources.tables import materialize_counted

ORDER_BITS = 60
BUCKET_BITS = 16
# Rows of a bucket, or of a range of values, that one task sorts.
CELL_ROWS = 1_000_000
# Ranges that a span of values is cut into.
RANGES = 4_096


def hash_order(key: str, seed: int) -> Column:
    """Repeatable pseudo-random order of rows by id: the first 15 hex digits of
    an MD5 sum, a number of 60 bits that any SQL engine can recompute."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def rank_cuts(
    df: DataFrame,
    group: str,
    key: str,
    order: Column,
    wanted: DataFrame,
    bits: int = BUCKET_BITS,
    cell_rows: int | None = None,
) -> DataFrame:
    """Order value and key of the row at each wanted rank of each group.

    ``key`` is unique, ``order`` comes from ``hash_order``, and ``wanted`` has the columns group, name and rank, where rank
    counts from 1 and ranks outside the group are left out.
    Gives group, name, cut_order and cut_key.

    Each level takes ``bits`` more bits of the order. Only buckets with more
    than ``cell_rows`` rows go to another level, 1e12 rows in a group to a second one.
    """
    cell_rows = cell_rows or CELL_ROWS
    rows = df.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_group"), F.col(key).alias("_key"), order.alias("_order")
    )
    targets = wanted.select(F.col(group).alias("_target"), F.lit(0).cast("bigint").alias("_parent"), "name", "rank")
    scope, used, picked = rows, 0, []
    while True:
        before, used = used, min(ORDER_BITS, used + bits)
        counts = scope.groupBy("_group", _bucket(used).alias("_bucket")).agg(F.count(F.lit(1)).alias("_size"))
        # At most 2 ** bits rows per group and bucket of the level above.
        counts = counts.withColumn("_above", F.shiftright("_bucket", used - before) if before else F.lit(0).cast("bigint"))
        upto = Window.partitionBy("_group", "_above").orderBy("_bucket")
        spans = counts.withColumn("_end", F.sum("_size").over(upto))
        deeper = (F.col("_size") > cell_rows) & F.lit(used < ORDER_BITS)
        # One row per wanted rank.
        cells, found = materialize_counted(
            spans.join(targets, (F.col("_group") == F.col("_target")) & (F.col("_above") == F.col("_parent")))
            .where((F.col("rank") > F.col("_end") - F.col("_size")) & (F.col("rank") <= F.col("_end")))
            .select(
                "_group", "_bucket", "name", (F.col("rank") - F.col("_end") + F.col("_size")).alias("rank"), deeper.alias("_deeper")
            ),
            "rank-cells",
            deeper=F.count_if("_deeper"),
        )
        picked.append(_picked(rows.withColumn("_bucket", _bucket(used)), cells.where(~F.col("_deeper"))))
        if not found["deeper"]:
            break
        large = cells.where("_deeper")
        targets = large.select(F.col("_group").alias("_target"), F.col("_bucket").alias("_parent"), "name", "rank")
        keyed = rows.withColumn("_bucket", _bucket(used)).withColumn("_cell", _cell())
        chosen = large.select(_cell().alias("_large")).distinct()
        scope = sized_join(keyed, chosen, "_cell", "_large", spread=F.col("_key")).select("_group", "_key", "_order")
    cuts = picked[0]
    for more in picked[1:]:
        cuts = cuts.unionByName(more)
    return cuts.withColumnRenamed("_group", group)


def _picked(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The row at each wanted rank within its bucket; the buckets are small enough to sort."""
    picks = cells.groupBy(_cell().alias("_wanted_cell")).agg(F.collect_list(F.struct("name", F.col("rank").alias("_at"))).alias("_picks"))
    inside = Window.partitionBy("_cell").orderBy("_order", "_key")
    return (
        sized_join(rows.withColumn("_cell", _cell()), picks, "_cell", "_wanted_cell", spread=F.col("_key"))
        .withColumn("_place", F.row_number().over(inside))
        .select("*", F.inline("_picks"))
        .where(F.col("_place") == F.col("_at"))
        .select("_group", "name", F.col("_order").alias("cut_order"), F.col("_key").alias("cut_key"))
    )


def _bucket(used: int) -> Column:
    return F.shiftright("_order", ORDER_BITS - used)


def _cell() -> Column:
    return F.concat_ws(":", F.col("_bucket").cast("string"), F.col("_group").cast("string"))


def at_or_before(order: Column, key: str, cut: str) -> Column:
    """True for rows up to the cut; never true where there is no cut."""
    return F.coalesce(
        (order < F.col(f"{cut}.cut_order"))
        | ((order == F.col(f"{cut}.cut_order")) & (F.col(key) <= F.col(f"{cut}.cut_key"))),
        F.lit(False),
    )


def _narrowed(values: DataFrame, rank: int, rows: int, most: int) -> tuple[DataFrame, int, int]:
    """A span of ``values`` with at most ``most`` rows, or of one value, that holds the
    rank; the rank within it; and its rows.

    Each round cuts the span into ``RANGES`` equal ranges and goes on with the one that
    holds the rank, between its least and largest value, so values far out cost one round.
    """
    low, high = values.agg(F.min("_value"), F.max("_value")).first()
    while rows > most and low < high:
        share = (F.col("_value") / 2 - low / 2) / (high / 2 - low / 2)
        ranges = (
            values.where(F.col("_value").between(low, high))
            .groupBy(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("_range"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high"))
        )
        # At most RANGES rows.
        for found in sorted(ranges.collect(), key=lambda r: r["_range"]):
            if rank <= found["n"]:
                low, high, rows = found["low"], found["high"], found["n"]
                break
            rank -= found["n"]
    return values.where(F.col("_value").between(low, high)), rank, rows


def exact_median(df: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """Interpolated median of a numeric column, as one row; NULL without values.

    Ranges of the values are narrowed until at most ``most`` rows are left, whose
    distinct values are counted one by one.
    """
    most = most or CELL_ROWS
    column = F.col(value).cast("double")
    values, found = materialize_counted(
        df.where(column.isNotNull()).select(column.alias("_value")), "values", rows=F.count(F.lit(1))
    )
    middle = []
    for rank in sorted({(found["rows"] + 1) // 2, found["rows"] // 2 + 1}):
        if not found["rows"]:
            break
        span, at, rows = (values, rank, found["rows"]) if found["rows"] <= most else _narrowed(values, rank, found["rows"], most)
        counted = span.groupBy("_value").agg(F.count(F.lit(1)).alias("_size"))
        upto = Window.orderBy("_value")
        ends = counted.withColumn("_end", F.sum("_size").over(upto))
        middle.append(ends.where((F.col("_end") - F.col("_size") < at) & (F.col("_end") >= at)).first()["_value"])
    median = math.fsum(middle) / len(middle) if middle else None
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("median"))
