"""Rule labels for tickets and what the rules gave."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.constants import CATEGORY_KEYWORDS, URGENCY_KEYWORDS
from threadloom.functions import rules

CATEGORY_WORDS = tuple(dict.fromkeys(word for words in CATEGORY_KEYWORDS.values() for word in words))


def score_columns(df: DataFrame, phrases=URGENCY_KEYWORDS) -> DataFrame:
    """Adds ``score_0`` to ``score_5`` in category order, and ``urgency``.

    The text is lowered once. Most texts hold no category word at all; one
    pattern over all of them finds that out, and the six are then skipped.
    """
    lowered = F.col("_lowered")
    scores = rules.category_scores(lowered).values()
    prepared = df.withColumn("_lowered", rules.plain_lower(F.col("text"))).withColumn(
        "_any", lowered.rlike(rules.whole_words(CATEGORY_WORDS))
    )
    return prepared.select(
        *df.columns,
        *(F.when(F.col("_any"), score).otherwise(0).alias(f"score_{i}") for i, score in enumerate(scores)),
        rules.urgency_score(F.col("text"), lowered, phrases).alias("urgency"),
    )


def with_scores(df: DataFrame) -> DataFrame:
    """Hit counts of the six categories, as a map from category to count."""
    pairs = [part for i, name in enumerate(CATEGORY_KEYWORDS) for part in (F.lit(name), F.col(f"score_{i}"))]
    return score_columns(df).select(*df.columns, F.create_map(*pairs).alias("scores"))


def _category() -> Column:
    return rules.pick_category({name: F.col(f"score_{i}") for i, name in enumerate(CATEGORY_KEYWORDS)}).alias(
        "category"
    )


def _priority() -> Column:
    return rules.priority_of(F.col("urgency")).alias("priority")


def with_category(df: DataFrame) -> DataFrame:
    return score_columns(df).select(*df.columns, _category())


def with_priority(df: DataFrame, phrases=URGENCY_KEYWORDS) -> DataFrame:
    return score_columns(df, phrases).select(*df.columns, _priority())


def label_tickets(df: DataFrame) -> DataFrame:
    """Category and priority from the ticket text alone."""
    return score_columns(df).select(*df.columns, _category(), _priority())


def label_distribution(labeled: DataFrame) -> DataFrame:
    """Rows (kind, label, tickets) for both labels in one pass."""
    return (
        labeled.groupingSets([["category"], ["priority"]], "category", "priority")
        .agg(F.count(F.lit(1)).alias("tickets"), F.grouping("category").alias("_by_priority"))
        .select(
            F.when(F.col("_by_priority") == 1, "priority").otherwise("category").alias("kind"),
            F.coalesce("category", "priority").alias("label"),
            "tickets",
        )
        .where(F.col("label").isNotNull())
    )


def labeling_report(labeled: DataFrame) -> DataFrame:
    """One row: number of tickets and the two distributions as maps."""
    counts = label_distribution(labeled)

    def as_map(kind: str):
        entry = F.when(F.col("kind") == kind, F.struct("label", "tickets"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    # One row per label: a handful of rows.
    maps = counts.agg(
        as_map("category").alias("category_distribution"), as_map("priority").alias("priority_distribution")
    )
    total = labeled.agg(F.count(F.lit(1)))
    return maps.select(total.scalar().alias("tickets_labeled"), "*")


def label_changes(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """How many tickets moved from which old label to which new one."""
    old = before.select("ticket_id", F.col(label).alias("old_label"))
    new = after.select("ticket_id", F.col(label).alias("new_label"))
    return (
        old.join(new, "ticket_id").groupBy("old_label", "new_label").agg(F.count(F.lit(1)).alias("tickets"))
    )


def miss_rate(battery: DataFrame) -> DataFrame:
    """Share of hand-made cases whose rule category differs from ``expected``."""
    wrong = (F.col("category") != F.col("expected")).cast("double")
    return with_category(battery).agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(wrong).cast("bigint").alias("misses"),
        F.avg(wrong).alias("miss_rate"),
    )
