"""Classification metrics from the confusion table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows (truth, prediction, n): the only pass over the data."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(confusion_rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted class.

    A division by zero gives 0.
    """
    n = F.col("n")
    hit = F.when(F.col("truth") == F.col("prediction"), n).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), n.alias("true"), F.lit(0).cast("bigint").alias("called"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("true"), n.alias("called"), F.lit(0).cast("bigint").alias("hits")),
    )

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    totals = (
        confusion_rows.select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("true").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    )
    return totals.select(
        "label",
        ratio(F.col("hits").cast("double"), F.col("called")).alias("precision"),
        ratio(F.col("hits").cast("double"), F.col("support")).alias("recall"),
        ratio(2.0 * F.col("hits"), F.col("support") + F.col("called")).alias("f1"),
        "support",
        "hits",
    )


def _averages() -> list[Column]:
    return [
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    ]


def summary(classes: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and weighted F1, as one row."""
    return classes.agg(*_averages())


def evaluate(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: the summary and ``per_class`` as a map from label to its numbers.

    The data, and with it any prediction, is gone over once.
    """
    # One row per class.
    entries = F.array_sort(F.collect_list(F.struct("label", F.struct("precision", "recall", "f1", "support"))))
    return per_class(confusion(df, truth, prediction)).agg(
        *_averages(), F.map_from_entries(entries).alias("per_class")
    )


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """The commonest label, the lowest on a tie, as a one-row table."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .count()
        .orderBy(F.col("count").desc(), F.col(label).asc())
        .limit(1)
        .select(label)
    )


def with_majority(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """``test`` with the majority label of ``train`` as its prediction."""
    return test.withColumn("prediction", majority_label(train, label).scalar())


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * n_class) of every class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "n", (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("weight")
    )
