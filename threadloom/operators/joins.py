"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.tables import materialize_counted

# A key with more rows than this is split over several tasks.
HOT_KEY_ROWS = 1_000_000
# A table is only broadcast after its rows have been measured to be at most this many bytes.
BROADCAST_BYTES = 64 << 20
# Parts for rows without a key, which match nothing and only need to be spread.
_NULL_PARTS = 4_096


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"spark.threadloom.{name}", str(default)))


def hot_key_rows(df: DataFrame) -> int:
    return _setting(df, "hotKeyRows", HOT_KEY_ROWS)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with too many rows for one task, with the number of parts to use.

    Counting combines map-side, so a hot key costs one row per map task. Every
    key listed has more than ``HOT_KEY_ROWS`` rows, so a table of N rows lists
    at most N / HOT_KEY_ROWS keys: 1e12 rows give at most 1e6 keys of 12 bytes.
    """
    rows = hot_key_rows(df)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_hot"))
        .count()
        .where(F.col("count") > rows)
        .select("_hot", F.ceil(F.col("count") / rows).cast("int").alias("_parts"))
    )


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether so many rows of a few numbers each may be broadcast."""
    return rows * 64 <= _setting(df, "broadcastBytes", BROADCAST_BYTES)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    *,
    spread: Column,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join of many ``left`` rows per key to ``right``, unique on its key.

    Hot keys of ``left`` are cut into parts by a hash of ``spread``, a value
    that differs between rows and stays the same when a task is tried again, and their ``right`` row is repeated once per
    part. All other keys join as usual. Left rows with a NULL key, which an
    outer join keeps, are spread out too. ``rows``, where it is known, bounds
    the rows of ``left``; so few that no key can be hot are not counted by key.
    """
    if rows is not None and rows <= hot_key_rows(left):
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    hot = hot_keys(left, left_key)
    parts = F.coalesce("_parts", F.lit(1))
    salted_left = (
        left.withColumn("_spread", F.xxhash64(spread))
        .join(F.broadcast(hot), F.col(left_key) == F.col("_hot"), "left")
        .withColumn(
            "_salt",
            F.pmod("_spread", F.when(F.col(left_key).isNull(), F.lit(_NULL_PARTS)).otherwise(parts)).cast("int"),
        )
        .drop("_hot", "_parts", "_spread")
    )
    salted_right = (
        right.join(F.broadcast(hot), F.col(right_key) == F.col("_hot"), "left")
        .withColumn("_salt_right", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_hot", "_parts")
    )
    on = (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_salt_right"))
    return salted_left.join(salted_right, on, how).drop("_salt", "_salt_right")


def sized_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    spread: Column | None = None,
) -> DataFrame:
    """Join to a table that is usually short, e.g. the ids found to repeat.

    The short side is written first, and measured on the way. Within the limit it is
    broadcast and ``left`` is not shuffled at all; beyond it the salted join
    takes over. ``spread`` is as there, a hash of the whole left row if it is not given.
    """
    right, found = materialize_counted(right, "sized-join", bytes=F.sum(row_bytes(right)))
    if found["bytes"] <= _setting(left, "broadcastBytes", BROADCAST_BYTES):
        return left.join(F.broadcast(right), F.col(left_key) == F.col(right_key), how)
    if spread is None:
        spread = F.xxhash64(*(F.col(f"`{f.name}`") for f in left.schema if f.dataType.typeName() not in ("map", "variant")))
    return salted_join(left, right, left_key, right_key, how, spread=spread)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: strings by their length, 16 bytes a column."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema:
        if field.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{field.name}`"), F.lit(0))
        elif field.dataType.typeName() in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0))
    return size
