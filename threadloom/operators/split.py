"""Exact stratified split and capped sample, without sorting whole classes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.constants import MAX_PER_CATEGORY, SEED, TRAIN_SHARE, VALIDATION_SHARE
from threadloom.operators.joins import sized_join
from threadloom.operators.ranks import at_or_before, hash_order, rank_cuts

_WHOLE = "decimal(38,0)"


def _shares(classes: DataFrame, group: str, size: str, part: str, total: Column, share: float) -> DataFrame:
    """Adds ``part``: how many rows each class gives to a share of ``total``.

    floor(share * total) rows are dealt out in proportion to ``size``; what
    rounding down leaves goes to the classes with the largest remainders, the
    lower label first. There is one row per class, so the windows are small.
    """
    everyone = Window.partitionBy()
    dealt = classes.withColumn("_all", total).withColumn("_want", F.floor(F.lit(share) * F.col("_all")))
    exact = F.col(size).cast(_WHOLE) * F.col("_want").cast(_WHOLE)
    dealt = (
        dealt.withColumn("_floor", F.floor(exact / F.col("_all").cast(_WHOLE)).cast("bigint"))
        .withColumn("_rest", (exact - F.col("_floor").cast(_WHOLE) * F.col("_all").cast(_WHOLE)).cast(_WHOLE))
        .withColumn("_place", F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col(group))))
        .withColumn("_short", F.col("_want") - F.sum("_floor").over(everyone))
    )
    return dealt.withColumn(
        part, F.col("_floor") + F.when(F.col("_place") <= F.col("_short"), 1).otherwise(0)
    ).drop("_all", "_want", "_floor", "_rest", "_place", "_short")


def split_sizes(
    df: DataFrame, group: str = "category", train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE
) -> DataFrame:
    """Rows per class in each part. Parts have the exact overall sizes."""
    everyone = Window.partitionBy()
    classes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    classes = _shares(classes, group, "n", "train", F.sum("n").over(everyone), train)
    classes = classes.withColumn("_left", F.col("n") - F.col("train"))
    classes = _shares(
        classes, group, "_left", "val", F.sum("_left").over(everyone), validation / (1 - train)
    )
    return classes.select(group, "n", "train", "val", (F.col("_left") - F.col("val")).alias("test"))


def stratified_split(
    df: DataFrame,
    group: str = "category",
    key: str = "ticket_id",
    train: float = TRAIN_SHARE,
    validation: float = VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with ``part`` (train, val, test), the same share of every class.

    Rows are taken in hash order of ``key``. The keys at the two cuts of each
    class are found from bucket counts, and rows are then compared with them
    in place, so the classes themselves are neither shuffled nor sorted.
    """
    sizes = split_sizes(df, group, train, validation)
    wanted = sizes.select(
        group,
        F.inline(
            F.array(
                F.struct(F.lit("train").alias("name"), F.col("train").alias("rank")),
                F.struct(F.lit("val").alias("name"), (F.col("train") + F.col("val")).alias("rank")),
            )
        ),
    )
    cuts = rank_cuts(df, group, key, hash_order(key, seed), wanted)
    # One row per class.
    per_class = cuts.groupBy(F.col(group).alias("_class")).agg(
        *(
            F.max(F.when(F.col("name") == name, F.struct("cut_order", "cut_key"))).alias(f"_{name}")
            for name in ("train", "val")
        )
    )
    joined = sized_join(
        df.where(F.col(group).isNotNull()).withColumn("_order", hash_order(key, seed)),
        per_class, group, "_class", "left", F.col(key),
    )
    part = (
        F.when(at_or_before(F.col("_order"), key, "_train"), "train")
        .when(at_or_before(F.col("_order"), key, "_val"), "val")
        .otherwise("test")
    )
    return joined.withColumn("part", part).drop("_order", "_class", "_train", "_val")


def capped_sample(
    df: DataFrame,
    group: str = "category",
    key: str = "ticket_id",
    cap: int = MAX_PER_CATEGORY,
    seed: int = SEED,
) -> DataFrame:
    """At most ``cap`` rows per group, small groups whole, NULL groups left out."""
    large = (
        df.where(F.col(group).isNotNull()).groupBy(group).count().where(F.col("count") > cap).select(
            group, F.lit("cap").alias("name"), F.lit(cap).cast("bigint").alias("rank")
        )
    )
    cuts = rank_cuts(df, group, key, hash_order(key, seed), large).select(
        F.col(group).alias("_class"), F.struct("cut_order", "cut_key").alias("_cut")
    )
    joined = sized_join(
        df.where(F.col(group).isNotNull()).withColumn("_order", hash_order(key, seed)),
        cuts, group, "_class", "left", F.col(key),
    )
    return joined.where(F.col("_cut").isNull() | at_or_before(F.col("_order"), key, "_cut")).drop(
        "_order", "_class", "_cut"
    )


def fixed_sample(df: DataFrame, key: str, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows; an error if there are fewer."""
    one_group = df.withColumn("_group", F.lit(0))
    rows = df.count()
    if rows < size:
        raise ValueError(f"cannot take {size} rows from {rows}")
    return capped_sample(one_group, "_group", key, size, seed).drop("_group")
