"""Exact top-k by inner product with M-trees.

Inner products become distances: a vector x gets one more component
sqrt(M^2 - |x|^2), M the largest norm of all, and a query gets 0 there; then |q - x|^2 = |q|^2 + M^2 - 2 q.x.
Rows are dealt evenly to groups, and each group is one tree, stored as a table of
pages. An entry of a page holds an object, the covering radius of what is below it and its
distance to the object above. A query goes through the pages best first and stops at
the first that cannot hold anything better; entries whose stored distance rules
them out by the triangle inequality are skipped without computing a distance.
"""

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import NUMBER_BATCH, batches
from threadloom.sources.tables import materialize, materialize_counted

# Rows of one tree, entries of one page, queries that one task takes through a tree.
GROUP, PAGE, BLOCK = 16_384, 256, 8_192
# Part of the largest distance that bounds give way by, for rounding.
_SLACK = 1e-9
_PAGES = "tree long, page int, leaf boolean, dim int, ids binary, vectors binary, radius binary, above binary, child binary"


class Tree:
    """Pages of one M-tree over vectors of one length, loaded in bulk."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, largest: float, page: int = PAGE):
        self.vectors, self.ids, self.page = vectors, ids, page
        x = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0.0))
        self.points = np.c_[x, rest]
        self.rng = np.random.default_rng(len(ids))
        self.pages: list[tuple] = []
        if len(ids):
            self._load(np.arange(len(ids)))

    def _to(self, rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(self.points[rows] - center).sum(axis=1))

    def _center(self, rows: np.ndarray) -> int:
        return int(rows[self._to(rows, self.points[rows].mean(axis=0)).argmin()])

    def _load(self, rows: np.ndarray) -> tuple[int, int, float]:
        """Page, object and covering radius of a subtree."""
        center = self._center(rows)
        if len(rows) <= self.page:
            above = self._to(rows, self.points[center])
            radius, child = np.zeros(len(rows)), np.full(len(rows), -1)
            entries, leaf = rows, True
        else:
            parts = [self._load(part) for part in self._split(rows)]
            entries = np.array([p[1] for p in parts])
            radius, child = np.array([p[2] for p in parts]), np.array([p[0] for p in parts])
            above, leaf = self._to(entries, self.points[center]), False
        self.pages.append((leaf, entries, radius, above, child))
        return len(self.pages) - 1, center, float((above + radius).max())

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows by the nearest of some drawn among them; equal rows are dealt evenly."""
        n = min(self.page, -(-len(rows) * 3 // (2 * self.page)))
        pivots = self.points[self.rng.choice(rows, n, replace=False)]
        near = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), 4_096):
            x = self.points[rows[at : at + 4_096]]
            near[at : at + 4_096] = ((pivots * pivots).sum(axis=1) - 2.0 * x @ pivots.T).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        parts = np.split(rows[order], np.flatnonzero(np.diff(near[order])) + 1)
        if max(map(len, parts)) > 0.9 * len(rows):
            parts = np.array_split(rows, n)
        return [p for p in parts if len(p)]


def search(pages: list[dict], query: np.ndarray, own: int, largest: float, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one tree, ties to the smaller id, without the query's own id."""
    if not pages:
        return []
    exact = query.astype(np.float64)
    norm = float(exact @ exact) + largest
    slack = _SLACK * (norm + 1.0)
    best: list[tuple[int, int]] = []
    limit = np.inf
    # Square of the least distance, page, distance to the object above.
    heap = [(0.0, len(pages) - 1, -1.0)]
    while heap:
        least, at, up = heapq.heappop(heap)
        if least > limit:
            break
        page = pages[at]
        rows = slice(None)
        if up >= 0.0 and limit < np.inf:
            reach = np.maximum(np.abs(up - page["above"]) - page["radius"], 0.0)
            rows = np.flatnonzero(reach * reach <= limit)
            if not len(rows):
                continue
        products = page["points"][rows] @ exact
        distances = norm - 2.0 * products
        if page["leaf"]:
            ids = page["ids"][rows]
            fit = np.flatnonzero((distances <= limit) & (ids != own))
            if len(fit) > k:
                cut = np.partition(distances[fit], k - 1)[k - 1] + slack
                fit = fit[distances[fit] <= cut]
            scores = page["vectors"][rows][fit] @ query
            best = sorted(
                itertools.chain(best, zip((-scores).tolist(), ids[fit].tolist(), strict=True))
            )[:k]
            if len(best) == k:
                limit = norm + 2.0 * best[-1][0] + slack
            continue
        to = np.sqrt(np.maximum(distances, 0.0))
        reach = np.maximum(to - page["radius"][rows], 0.0) ** 2
        for r, d, child in zip(reach.tolist(), to.tolist(), page["child"][rows].tolist(), strict=True):
            if r <= limit:
                heapq.heappush(heap, (r, child, d))
    return [(-score, name) for score, name in best]


# --- Spark ----------------------------------------------------------------------


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; NULL where the vector or one of them is NULL or not finite."""
    finite = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(finite, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def index(rows: DataFrame, largest: float, groups: int, page: int = PAGE) -> DataFrame:
    """Pages of the trees over ``rows`` (place, id, vector), written to the shared folder."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = frame["vector"].map(len)
        # Vectors of different lengths have no inner product; they get trees of their own.
        for dim, part in frame.groupby(sizes):
            vectors = np.stack(part["vector"].to_numpy()).astype(np.int64).reshape(len(part), dim)
            tree = Tree(vectors, part["id"].to_numpy(), largest, page)
            for number, (leaf, entries, radius, above, child) in enumerate(tree.pages):
                out.append(
                    (
                        int(frame["tree"].iloc[0]), number, leaf, dim, tree.ids[entries].astype("<i8").tobytes(),
                        vectors[entries].astype("<i8").tobytes(), radius.astype("<f8").tobytes(),
                        above.astype("<f8").tobytes(), child.astype("<i4").tobytes(),
                    )
                )
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PAGES.split(", ")])

    dealt = rows.select(F.pmod(F.xxhash64("place"), F.lit(groups)).alias("tree"), "id", "vector")
    return materialize(dealt.groupBy("tree").applyInPandas(build, _PAGES), "mtree-pages")


def _loaded(frame: pd.DataFrame) -> dict[int, list[dict]]:
    """Pages of one group by length of the vectors."""
    trees: dict[int, list[dict]] = {}
    for row in frame.sort_values("page").itertuples(index=False):
        ids = np.frombuffer(row.ids, "<i8")
        vectors = np.frombuffer(row.vectors, "<i8").reshape(len(ids), row.dim)
        trees.setdefault(row.dim, []).append(
            {
                "leaf": row.leaf,
                "ids": ids,
                "vectors": vectors,
                "points": vectors.astype(np.float64),
                "radius": np.frombuffer(row.radius, "<f8"),
                "above": np.frombuffer(row.above, "<f8"),
                "child": np.frombuffer(row.child, "<i4"),
            }
        )
    return trees


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 256,
    group: int = GROUP,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest integer inner products of each query row.

    Rows without id, without vector, or with a component that is NULL or not
    finite take no part. Rows with the id of the query count as its own. A repeated
    query row is answered each time. Vectors are compared with those of their length. Fewer rows
    than k give all; empty tables none. Scores are 64-bit numbers.

    Blocks of queries meet every tree, each pair in a task of its own; a tree
    gives k rows per query, and ranks are cut again before the last shuffle.
    """
    spark = vectors.sparkSession
    table = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        whole_numbers(F.col(f"`{embedding}`"), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("place"),
    ).where("id IS NOT NULL AND vector IS NOT NULL")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, found = materialize_counted(
        table, "vectors", n=F.count(F.lit(1)), asks=F.count_if("asks"), largest=F.ceil(F.max(square))
    )
    largest = float(found["largest"])
    groups, blocks = max(1, -(-found["n"] // group)), max(1, -(-found["asks"] // block))
    pages = index(rows, largest, groups)
    number = F.pmod(F.xxhash64("place", F.lit(1)), F.lit(blocks)).alias("block")
    asked = rows.where("asks").select(
        F.explode(_numbers(groups)).alias("tree"), number, "place", "id", "vector"
    )
    dealt = pages.withColumn("block", F.explode(_numbers(blocks)))
    schema = "place long, query_id long, vec_id long, score long"

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trees, out = _loaded(right), []
        for row in left.itertuples(index=False):
            query = np.asarray(row.vector, np.int64)
            for score, name in search(trees.get(len(query), []), query, row.id, largest, k):
                out.append((row.place, row.id, name, score))
        return pd.DataFrame(out, columns=["place", "query_id", "vec_id", "score"]).astype("int64")

    with batches(spark, NUMBER_BATCH):
        near = materialize(
            asked.groupBy("tree", "block").cogroup(dealt.groupBy("tree", "block")).applyInPandas(answer, schema), "nearest"
        )
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
