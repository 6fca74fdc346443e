"""Connected components of links between 64-bit nodes.

Alternating large-star and small-star steps: each moves links to the smallest
neighbour, keeps the components and needs about log2 rounds. Links are written
to the shared folder after every round; no list of nodes or links leaves Spark.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.joins import salted_join
from threadloom.sources.tables import materialize_counted


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b, after one step; neighbours meet at each node.

    Large: every node sends its larger neighbours to its smallest one.
    Small: every node sends its smaller neighbours and itself to the smallest.
    The smallest is an aggregate, so a node with very many links costs no task
    more than its own share; the join back is salted.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least"))
    joined = salted_join(both, least, "a", "node", spread=F.col("b"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every
    node that has a link. ``links`` has two long columns a and b, any order.

    Links to itself and repeated links count for nothing; no links give no rows.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state, mark = _written(ordered.where("a > b").distinct())
    while mark["n"]:
        moved, after = _written(_star(_star(state, large=True), large=False))
        same, state, mark = after == mark, moved, after
        # A round that changes nothing leaves count and sums as they were; the
        # exact test runs only then.
        if same and state.groupBy("a").count().where("count > 1").isEmpty() and state.join(
            state.select(F.col("a").alias("other")), F.col("b") == F.col("other"), "left_semi"
        ).isEmpty():
            break
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _written(links: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Links on shared storage with their number and check sums of both ends."""
    low = F.lit((1 << 31) - 1)
    return materialize_counted(
        links,
        "links",
        n=F.count(F.lit(1)),
        a=F.sum(F.xxhash64("a").bitwiseAND(low)),
        b=F.sum(F.xxhash64("b").bitwiseAND(low)),
    )
