"""Nearest neighbours by squared distance, in tiles of bounded size.

Queries are cut into parts and the index into tiles, evenly by a hash of the
id, and a part meets a tile in one task. A task holds one part and one tile,
multiplies them as matrices and keeps k rows per query, so neither side has to
fit in a task or on the driver and no pair is written out.

``nearest`` lets every part meet every tile, which suits small sides.
``nearest_cells`` puts the index into cells around centres, and a query is
compared with the rows of its nearest cells alone. ``nearest_pruned`` gives the
exact rows from the cells that can hold them, and ``nearest_calibrated`` probes
as many cells as a recall needs that is asked for. A tile of these three is a
group of neighbouring cells, and a query is sent once to each group.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.constants import SEED, TOP_K
from threadloom.operators.joins import salted_join
from threadloom.sources.tables import materialize, materialize_counted

# Bytes of the vectors, as doubles, of each side in one task, and of differences at a time.
PART_BYTES = 64 << 20
TILE_BYTES = 64 << 20
_PAIR_BYTES = 8 << 20
# Bytes of a matrix product at a time.
_PRODUCT_BYTES = 8 << 20
_BLOCK = 128
# About so many index vectors fit the centres, of which there are at most so many by default.
SAMPLE_ROWS = 100_000
MOST_CELLS = 4_096


def _rows_in(room: int, length: int) -> int:
    """Vectors of that length, as doubles, that ``room`` bytes hold."""
    return max(1, room // (8 * max(1, length)))


class _Block:
    """The k nearest so far of a block of queries: row, index position and distance.

    The matrix product finds everything that can be among the k nearest;
    distances of those are then taken from the differences, so equal vectors
    get equal distances and ties go to the lower id. Only what the k-th so far, or a bound
    known before, does not rule out is looked at. With ``twice`` a row may be in the index
    twice, with one id, and counts once.
    """

    def __init__(
        self, queries: np.ndarray, index: np.ndarray, norms: np.ndarray, ids: np.ndarray, k: int, bound=np.inf, twice: bool = False
    ):
        self.queries, self.index, self.norms, self.ids = queries, index, norms, ids
        self.k, self.twice = min(k, index.shape[0]), twice
        self.depth = min(k * (1 + twice), index.shape[0])
        self.scaled, self.lengths = -2.0 * queries, (queries * queries).sum(axis=1)
        self.slack = 1e-9 * (1.0 + self.lengths + norms.max())
        self.bound = np.full(len(queries), bound)
        self.row, self.position, self.distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def look(self, low: int, high: int, rows=slice(None), open_: np.ndarray | None = None) -> None:
        """Compare ``rows`` of the block with a stretch of the index, where ``open_`` if that is given."""
        rough = self.scaled[rows] @ self.index[low:high].T
        rough += self.norms[low:high]
        if open_ is not None:
            rough[~open_] = np.inf
        lengths, slack = self.lengths[rows], self.slack[rows]
        limit = self.bound[rows] + slack - lengths
        near = (rough <= limit[:, None]).ravel()
        if open_ is not None:
            near &= open_.ravel()
        if rough.shape[1] > self.depth and np.count_nonzero(near) > 4 * self.depth * len(rough):
            limit = np.minimum(limit, np.partition(rough, self.depth - 1, axis=1)[:, self.depth - 1] + 2.0 * slack)
            near &= (rough <= limit[:, None]).ravel()
        at, new_position = np.divmod(np.flatnonzero(near), high - low)
        if not len(at):
            return
        new_row, new_position = np.arange(len(self.queries))[rows][at], low + new_position
        new, step = np.empty(len(new_row)), _rows_in(_PAIR_BYTES, self.index.shape[1])
        for start in range(0, len(new), step):
            span = slice(start, start + step)
            new[span] = np.square(self.queries[new_row[span]] - self.index[new_position[span]]).sum(axis=1)
        row, position, distance = (
            np.concatenate(both)
            for both in ((self.row, new_row), (self.position, new_position), (self.distance, new))
        )
        order = np.lexsort((self.ids[position], distance, row))
        if self.twice:
            of = self.ids[position[order]]
            again = (np.diff(row[order]) == 0) & (np.diff(of) == 0) & (np.diff(distance[order]) == 0)
            order = order[np.concatenate([[True], ~again])]
        row, position, distance = row[order], position[order], distance[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep, last = place < self.k, place == self.k - 1
        self.bound[row[last]] = np.minimum(self.bound[row[last]], distance[last])
        self.row, self.position, self.distance = row[keep], position[keep], distance[keep]


def _wide(rows: int, k: int) -> int:
    """Index rows in a stretch, so that a product takes a few MB whatever the size of the index."""
    return max(k, _PRODUCT_BYTES // (8 * max(1, rows)))


def closest(queries: np.ndarray, index: np.ndarray, ids: np.ndarray, k: int):
    """For one block of queries: row, index position and distance of the k nearest."""
    block = _Block(queries, index, (index * index).sum(axis=1), ids, k)
    wide = _wide(len(queries), k)
    for low in range(0, len(index), wide):
        block.look(low, min(len(index), low + wide))
    return block.row, block.position, block.distance


def _cell_kernel(k: int):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        names, found = left["query_id"].combine_chunks(), []
        ids = right["id"].combine_chunks()
        if len(left) and len(right):
            index = _matrix(right["index_vector"].combine_chunks())
            ranks = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            vectors = left["query_vector"].combine_chunks()
            for start in range(0, len(left), _BLOCK):
                row, position, distance = closest(_matrix(vectors.slice(start, _BLOCK)), index, ranks, k)
                found.append((start + row, position, distance))
        row, position, distance = (np.concatenate(part) for part in zip(*found, strict=True)) if found else ([], [], [])
        return pa.table(
            {
                "query_id": names.take(pa.array(row, pa.int64())),
                "id": ids.take(pa.array(position, pa.int64())),
                "distance": pa.array(distance, pa.float64()),
            }
        )

    return kernel


def _measured(queries: DataFrame, index: DataFrame) -> tuple[DataFrame, int, DataFrame, int, int]:
    """Both sides without NULL vectors, their rows and the length of the vectors.

    Queries are written and measured in one pass, so that an encoder before
    them runs once; the index is a stored table already. The names are new,
    since both sides may come from one table.
    """
    measures = {"rows": F.count(F.lit(1)), "length": F.max(F.size("vector"))}
    known = F.col("vector").isNotNull()
    queries, asked = materialize_counted(queries.select("query_id", "vector").where(known), "queries", **measures)
    index = index.select("id", "vector").where(known)
    held = index.agg(*(measure.alias(name) for name, measure in measures.items())).first()
    queries, index = queries.withColumnRenamed("vector", "query_vector"), index.withColumnRenamed("vector", "index_vector")
    return queries, asked["rows"], index, held["rows"], max(asked["length"], held["length"] or 0)


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count.cast("int") - 1))


def _found(left: DataFrame, right: DataFrame, keys: list[str], kernel) -> DataFrame:
    """The k nearest in each group that a query is in."""
    schema = T.StructType([left.schema["query_id"], right.schema["id"], T.StructField("distance", T.DoubleType())])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def _placed(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all groups; k rows per query and group are compared."""
    by_distance = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(by_distance)).where(F.col("place") <= k)


def _closest_open(block: _Block, starts: np.ndarray, cells: np.ndarray) -> None:
    """Compare a block with the cells that are open to each query: ``cells`` is a row a query, a column a cell.

    The rows of a cell stand together from its place in ``starts``. A stretch of cells most of which are open
    is compared in one product, and one with few of them cell by cell.
    """
    ends = np.append(starts[1:], len(block.index))
    wide, first = _wide(len(cells), block.k), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + wide, side="right")))
        asked = cells[:, first:last]
        rows = np.flatnonzero(asked.any(axis=1))
        if len(rows):
            sizes = ends[first:last] - starts[first:last]
            open_ = asked[rows]
            whole = bool(open_.all())
            if whole or (open_ @ sizes).sum() * 4 >= len(rows) * sizes.sum():
                # A cell may be larger than a stretch; then it is alone in this one.
                for low in range(starts[first], ends[last - 1], wide):
                    high = min(low + wide, ends[last - 1])
                    if whole:
                        block.look(low, high, rows)
                    else:
                        block.look(low, high, rows, np.repeat(open_, sizes, axis=1)[:, low - starts[first] : high - starts[first]])
            else:
                for cell in np.flatnonzero(asked.any(axis=0)):
                    wanting = np.flatnonzero(asked[:, cell])
                    for low in range(starts[first + cell], ends[first + cell], wide):
                        block.look(low, min(low + wide, ends[first + cell]), wanting)
        first = last


def _group_kernel(k: int, wanted, twice: bool):
    """The k nearest in a tile of cells; ``wanted(queries, vectors, cells)`` gives a bound and the open cells."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids, found = left["query_id"].combine_chunks(), right["id"].combine_chunks(), []
        if len(left) and len(right):
            cell = right["_cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            numbers, starts = np.unique(cell[order], return_index=True)
            ids = ids.take(pa.array(order))
            index = _matrix(right["index_vector"].combine_chunks())[order]
            norms = np.einsum("ij,ij->i", index, index)
            named = ids.to_numpy(zero_copy_only=False)
            if twice:
                ranks = np.unique(named, return_inverse=True)[1]
            else:
                ranks = np.argsort(np.argsort(named, kind="stable"), kind="stable")
            for start in range(0, len(left), _BLOCK):
                some = left.slice(start, _BLOCK)
                vectors = _matrix(some["query_vector"].combine_chunks())
                bound, cells = wanted(some, vectors, numbers)
                block = _Block(vectors, index, norms, ranks, k, bound, twice)
                _closest_open(block, starts, cells)
                found.append((start + block.row, block.position, block.distance))
        row, position, distance = (np.concatenate(part) for part in zip(*found, strict=True)) if found else ([], [], [])
        return pa.table(
            {
                "query_id": names.take(pa.array(row, pa.int64())),
                "id": ids.take(pa.array(position, pa.int64())),
                "distance": pa.array(distance, pa.float64()),
            }
        )

    return kernel


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry."""
    lists = lists.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)


def _listed(some: pa.Table, vectors: np.ndarray, numbers: np.ndarray):
    """The cells in ``_cells``, or all if that is NULL."""
    lists = some["_cells"]
    cells = np.zeros((len(some), len(numbers)), bool)
    cells[lists.is_null().to_numpy()] = True
    row, value = _flat(lists.fill_null([]) if lists.null_count else lists)
    at = np.minimum(np.searchsorted(numbers, value), len(numbers) - 1)
    here = numbers[at] == value
    cells[row[here], at[here]] = True
    return np.inf, cells


class _Groups:
    """Neighbouring cells in groups that fill a tile; a cell that is larger is alone and has several tiles.

    Half a tile is taken, since the rows are held twice while they are put in order, and less where
    the index would come to so few tiles that slots were idle.
    """

    def __init__(self, spark: SparkSession, cells: dict[int, int], places: np.ndarray, length: int):
        """``cells`` has the rows of every cell by its number, ``places`` a centre for each of them in that order."""
        self.spark = spark
        self.slots = 4 * spark.sparkContext.defaultParallelism
        self.cells, self.rows, self.length = list(cells), np.array(list(cells.values()), np.int64), length
        even = math.ceil(self.rows.sum() / math.isqrt(self.slots))
        self.room = min(_rows_in(TILE_BYTES // 2, length), max(4 * _BLOCK, even))
        of, todo, self.count = np.zeros(len(self.rows), np.int64), [np.arange(len(self.rows))] if len(self.rows) else [], 0
        while todo:
            some = todo.pop()
            total = self.rows[some].sum()
            if len(some) == 1 or total <= self.room:
                of[some] = self.count
                self.count += 1
                continue
            axis = np.ptp(places[some], axis=0).argmax()
            some = some[np.argsort(places[some, axis], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(self.rows[some]), total / 2), 1, len(some) - 1))
            todo += [some[half:], some[:half]]
        # By number of the cell; -1 for cells without rows.
        self.of = np.full(max(self.cells, default=-1) + 1, -1)
        self.of[self.cells] = of
        self.sizes = np.bincount(of, minlength=self.count)

    def shares(self):
        """From a list of cells to the groups they are in, each with its cells of the list, or NULL for all it has."""
        # Bounded by the number of cells.
        shared = self.spark.sparkContext.broadcast((self.of, self.sizes))

        @F.arrow_udf("array<struct<_group: int, _cells: array<int>>>")
        def share(lists: pa.Array) -> pa.Array:
            return pa.concat_arrays([_shares(lists.slice(at, _BLOCK), *shared.value) for at in range(0, max(1, len(lists)), _BLOCK)])

        return share

    def layout(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Tiles and parts by ``_group`` and by ``_cell``, of the groups that are asked for."""
        # One row per group.
        wanted = {r["_group"]: r["n"] for r in asked.groupBy("_group").agg(F.count("query_id").alias("n")).collect()}
        held = np.zeros(self.count, np.int64)
        np.add.at(held, self.of[self.cells], self.rows)
        tiles = -(-held // self.room)
        spread = math.ceil(self.slots / max(1, tiles.sum()))
        most = _rows_in(PART_BYTES, self.length)
        by_group = {
            group: (group, int(tiles[group]), max(1, math.ceil(n / most), min(spread, n // (4 * _BLOCK))))
            for group, n in wanted.items()
            if group < self.count
        }
        by_cell = [(cell, *by_group[self.of[cell]]) for cell in self.cells if self.of[cell] in by_group]
        columns = ("_group", "_tiles", "_parts")
        return self._table(list(by_group.values()), *columns), self._table(by_cell, "_cell", *columns)

    def _table(self, rows: list[tuple], *names: str) -> DataFrame:
        """Rows of whole numbers; as Arrow, since a list of rows would go through Python workers."""
        schema = pa.schema([(name, pa.int32()) for name in names])
        return self.spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema))


def _shares(lists: pa.Array, of: np.ndarray, sizes: np.ndarray) -> pa.Array:
    row, cell = _flat(pa.chunked_array([lists]))
    held = cell < len(of)
    row, cell = row[held], cell[held].astype(np.int64)
    held = of[cell] >= 0
    row, cell = row[held], cell[held]
    order = np.lexsort((cell, of[cell], row))
    row, cell, group = row[order], cell[order], of[cell[order]]
    begins = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
    lengths = np.diff(begins, append=len(row))
    whole = lengths == sizes[group[begins]]
    ends = np.concatenate([[0], np.cumsum(np.where(whole, 0, lengths))]).astype(np.int32)
    part = pa.array(cell[np.repeat(~whole, lengths)].astype(np.int32))
    cells = pa.ListArray.from_arrays(pa.array(ends), part, mask=pa.array(whole))
    entries = pa.StructArray.from_arrays([pa.array(group[begins].astype(np.int32)), cells], ["_group", "_cells"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[begins], np.arange(len(lists) + 1)).astype(np.int32)), entries)


def _meet(
    asked: DataFrame, index: DataFrame, groups: _Groups, k: int, wanted=_listed, twice: bool = False
) -> DataFrame:
    """Queries meet the groups of cells they ask for: ``asked`` has a row for each ``_group`` of a query, ``index`` has ``_cell``.

    What ``wanted`` needs comes with the query. The queries of a group are cut into parts, so tasks stay within bounds.
    """
    by_group, by_cell = (F.broadcast(layout) for layout in groups.layout(asked))
    left = (
        asked.join(by_group, "_group")
        .withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int"))
        .withColumn("_tile", _every(F.col("_tiles")))
        .drop("_tiles", "_parts")
    )
    right = (
        index.join(by_cell, "_cell")
        .withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
        .withColumn("_part", _every(F.col("_parts")))
        .drop("_tiles", "_parts")
    )
    return _found(left, right, ["_group", "_tile", "_part"], _group_kernel(k, wanted, twice))


def _shared_out(queries: DataFrame, groups: _Groups, cells: str) -> DataFrame:
    """A row for each group that the list ``cells`` of a query is in, with the cells there."""
    shares = queries.select("query_id", "query_vector", F.explode(groups.shares()(cells)).alias("_share"))
    return shares.select("query_id", "query_vector", "_share.*")


def nearest(queries: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k nearest index rows of every query: query_id, id, distance, place.

    ``queries`` has query_id and vector, ``index`` has id and vector. Places
    count from 1 by distance, then id. Vectors that are NULL match nothing.
    """
    queries, query_rows, index, index_rows, length = _measured(queries, index)
    slots = queries.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(index_rows / _rows_in(TILE_BYTES, length)))
    spread = min(math.ceil(slots / tiles), query_rows // (4 * _BLOCK))
    parts = max(1, math.ceil(query_rows / _rows_in(PART_BYTES, length)), spread)
    left = queries.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn(
        "_tile", _every(F.lit(tiles))
    )
    right = index.withColumn("_tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn(
        "_part", _every(F.lit(parts))
    )
    return _placed(_found(left, right, ["_part", "_tile"], _cell_kernel(k)), k)


def _centres(index: DataFrame, rows: int, length: int, cells: int, sample_rows: int, seed: int) -> np.ndarray:
    """Centres of about ``sample_rows`` index vectors, chosen by a hash of the id."""
    if min(cells, rows) < 2:
        return np.zeros((1, length))
    range_ = 1 << 40
    chosen = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(range_)) < int(range_ * min(1.0, sample_rows / rows))
    points = index.where(chosen).select(array_to_vector(F.col("index_vector").cast("array<double>")).alias("point"))
    model = KMeans(featuresCol="point", k=cells, seed=seed, maxIter=10).fit(points)
    return np.array(model.clusterCenters())


def _cells_of(spark: SparkSession, centres: np.ndarray, count: int):
    """The ``count`` cells nearest to a vector, nearest first."""
    # Bounded by the number of cells.
    shared = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        centres = shared.value
        norms = (centres * centres).sum(axis=1)
        points = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        order = [
            np.argsort(norms - 2.0 * (points[start : start + _BLOCK] @ centres.T), axis=1, kind="stable")[:, :count]
            for start in range(0, len(points), _BLOCK)
        ]
        flat = np.concatenate(order).ravel() if order else np.empty(0)
        offsets = np.arange(len(points) + 1, dtype=np.int32) * count
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))

    return cells


def _held(index: DataFrame, centres: np.ndarray) -> tuple[dict[int, int], np.ndarray]:
    """The rows of every cell that has some, and the centres of those."""
    # One row per cell.
    held = dict(sorted(map(tuple, index.groupBy("_cell").agg(F.count(F.lit(1))).collect())))
    return held, centres[list(held)]


def nearest_cells(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    cells: int | None = None,
    probes: int | None = None,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """As ``nearest``, but a query meets the rows of its ``probes`` nearest cells only.

    ``cells`` centres (by default the square root of the index rows, at most
    ``MOST_CELLS``) are fitted on about ``sample_rows`` index vectors; every
    index row is in the cell of its nearest centre. All rows of a probed cell
    are compared, however many. With ``probes`` None all cells are, and the
    rows are those of ``nearest``. A query whose cells hold fewer than k rows
    gets as many as they hold.

    Cells are put together to tiles, and a query is sent once to each tile that
    has cells of its own, so that what is shuffled grows with the tiles and not with the
    cells. A large cell is cut into tiles and the queries of a tile into parts; each
    part gets a copy of the tile.
    """
    spark = queries.sparkSession
    queries, _, index, index_rows, length = _measured(queries, index)
    centres = _centres(index, index_rows, length, cells or min(MOST_CELLS, math.isqrt(index_rows)), sample_rows, seed)
    count = min(probes or len(centres), len(centres))
    index = materialize(index.withColumn("_cell", _cells_of(spark, centres, 1)("index_vector")[0]), "index-cells")
    groups = _Groups(spark, *_held(index, centres), length)
    if count == len(centres):
        asked = queries.withColumn("_group", _every(F.lit(max(1, groups.count)))).withColumn("_cells", F.lit(None).cast("array<int>"))
    else:
        probed = queries.withColumn("_probed", _cells_of(spark, centres, count)("query_vector"))
        asked = materialize(_shared_out(probed, groups, "_probed"), "query-cells")
    return _placed(_meet(asked, index, groups, k), k)


# --- exact answers from a part of the cells -------------------------------------


@dataclass
class Pruned:
    """``hits`` as of ``nearest``; of all pairs of a query and a ring, how many were looked at."""

    hits: DataFrame
    visited: int
    pairs: int


class _Rings:
    """Rings of the cells: the rows of a cell between two distances from its centre."""

    def __init__(self, centres: np.ndarray, rings: list[tuple[int, int, int, float, float]]):
        """``rings`` are (number, cell, rows, least and most distance)."""
        self.centres = centres
        self.number, self.cell, self.rows = (np.array([r[i] for r in rings], np.int64) for i in range(3))
        self.low, self.high = (np.array([r[i] for r in rings]) for i in (3, 4))

    def bounds(self, points: np.ndarray, some=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the centres of the rings' cells, and the least that a row of each ring can have.

        The second is lowered by more than rounding can raise it. ``some`` are places of rings.
        """
        cells, which = np.unique(self.cell[some], return_inverse=True)
        away = _distances(points, self.centres[cells])[:, which]
        least = np.maximum(0.0, np.maximum(away - self.high[some], self.low[some] - away))
        slack = _SLACK * (1.0 + away + self.high[some])
        return away, np.maximum(0.0, least - slack)

    def reach(self, points: np.ndarray, bounds: np.ndarray, seen: tuple[np.ndarray, np.ndarray], some=slice(None)) -> np.ndarray:
        """Which rings may hold a row within the bound of a query, without those seen (row, number)."""
        near = self.bounds(points, some)[1] <= np.sqrt(bounds)[:, None] * (1.0 + _SLACK)
        numbers, (row, number) = self.number[some], seen
        at = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
        here = numbers[at] == number
        near[row[here], at[here]] = False
        return near


# Relative error that is granted to distances taken from products.
_SLACK = 1e-6


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2.0 * (points @ centres.T)
    return np.sqrt(np.maximum(0.0, square))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _first_rings(shared, k: int):
    """The rings that are nearest by their bounds and hold k rows together."""

    @F.arrow_udf("array<int>")
    def first(vectors: pa.Array) -> pa.Array:
        rings, points, out = shared.value, _matrix(vectors), []
        for start in range(0, len(points), _BLOCK):
            away, least = rings.bounds(points[start : start + _BLOCK])
            for row in np.lexsort((away, least), axis=1):
                enough = int(np.searchsorted(np.cumsum(rings.rows[row]), k)) + 1
                out.append(rings.number[row[:enough]])
        return _lists(out)

    return first


def _other_groups(shared, of: np.ndarray):
    """The groups of rings that may hold a row within the bound, and how many rings, without those looked at already."""

    @F.arrow_udf("struct<groups: array<int>, rings: int>")
    def other(vectors: pa.Array, bounds: pa.Array, seen: pa.Array) -> pa.Array:
        rings, points, groups, counts = shared.value, _matrix(vectors), [], []
        limit = bounds.to_numpy(zero_copy_only=False)
        if not len(rings.number):
            return pa.StructArray.from_arrays([_lists([[]] * len(points)), pa.array([0] * len(points), pa.int32())], ["groups", "rings"])
        # Rings by group, so that those of a group stand together.
        mine = of[rings.number]
        order = np.argsort(mine, kind="stable")
        numbers, begins = np.unique(mine[order], return_index=True)
        for start in range(0, len(points), _BLOCK):
            span = slice(start, start + _BLOCK)
            near = rings.reach(points[span], limit[span], _flat(pa.chunked_array([seen.slice(start, _BLOCK)])))
            counts.append(near.sum(axis=1))
            groups += [numbers[row] for row in np.logical_or.reduceat(near[:, order], begins, axis=1)]
        counts = np.concatenate(counts) if counts else np.empty(0)
        return pa.StructArray.from_arrays([_lists(groups), pa.array(counts.astype(np.int32))], ["groups", "rings"])

    return other


def _in_reach(shared):
    """The rings of a tile that ``_bound`` does not rule out, without ``_seen``."""

    def wanted(some: pa.Table, vectors: np.ndarray, numbers: np.ndarray):
        rings, bound = shared.value, some["_bound"].to_numpy()
        return bound, rings.reach(vectors, bound, _flat(some["_seen"]), np.searchsorted(rings.number, numbers))

    return wanted


def nearest_pruned(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    cells: int | None = None,
    rings: int = 4,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> Pruned:
    """The rows of ``nearest``, from those parts of the index that can hold them.

    Index rows are in the cell of their nearest centre and there in one of
    ``rings`` by their distance from it. Every ring knows its least and largest
    distance, so by the triangle inequality it has a least distance from a
    query. First a query meets the nearest rings that hold k rows; the distance
    of the last of those bounds its answer, and then it meets the rings
    that the bound does not rule out. Tasks get parts and tiles of bounded size
    as in ``nearest_cells``: a query goes once to each tile that has such a ring, with the
    bound and no list of rings. A query with fewer than k rows to find meets all.
    """
    spark = queries.sparkSession
    queries, asked, index, index_rows, length = _measured(queries, index)
    centres = _centres(index, index_rows, length, cells or min(MOST_CELLS, math.isqrt(index_rows)), sample_rows, seed)
    centre = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<cell: int, away: double>")
    def placed(vectors: pa.Array) -> pa.Array:
        points = _matrix(vectors)
        found = [_distances(points[at : at + _BLOCK], centre.value) for at in range(0, len(points), _BLOCK)]
        cell = np.concatenate([d.argmin(axis=1) for d in found]) if found else np.empty(0)
        away = np.concatenate([d.min(axis=1) for d in found]) if found else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(away)], ["cell", "away"])

    in_cells = materialize(index.withColumn("_at", placed("index_vector")).select("id", "index_vector", "_at.*"), "index-cells")
    # One row per cell, and per ring: at most MOST_CELLS by default, times ``rings``.
    widest = in_cells.groupBy("cell").agg(F.max("away").alias("_wide"))
    ring = F.when(F.col("_wide") > 0, F.least(F.floor(F.col("away") / F.col("_wide") * rings), F.lit(rings - 1))).otherwise(0)
    index = materialize(
        in_cells.join(F.broadcast(widest), "cell").withColumn("_cell", (F.col("cell") * rings + ring).cast("int")), "index-rings"
    )
    known = index.groupBy("_cell").agg(
        F.first("cell").alias("cell"), F.count(F.lit(1)).alias("rows"), F.min("away").alias("low"), F.max("away").alias("high")
    )
    rings_ = _Rings(centres, sorted(map(tuple, known.collect())))
    shared = spark.sparkContext.broadcast(rings_)
    groups = _Groups(spark, dict(zip(rings_.number.tolist(), rings_.rows.tolist(), strict=True)), centres[rings_.cell], length)
    index = index.select("id", "index_vector", "_cell")
    begun = materialize(queries.withColumn("_seen", _first_rings(shared, k)("query_vector")), "query-rings")
    nearest_rings = materialize(_shared_out(begun, groups, "_seen"), "query-groups")
    first = materialize(_meet(nearest_rings, index, groups, k), "first-hits")
    # The k-th of the first hits; without so many, everything is looked at.
    bounds = _placed(first, k).groupBy(F.col("query_id").alias("_id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("_bound")
    )
    wanted = begun.join(bounds, F.col("query_id") == F.col("_id"), "left").withColumn(
        "_bound", F.coalesce("_bound", F.lit(float("inf")))
    )
    more = _other_groups(shared, groups.of)("query_vector", "_bound", "_seen")
    rest, found = materialize_counted(
        wanted.withColumn("_more", more), "query-rings", visited=F.sum(F.size("_seen") + F.col("_more.rings"))
    )
    later = rest.select("query_id", "query_vector", "_bound", "_seen", F.explode("_more.groups").alias("_group"))
    later = _meet(later, index, groups, k, _in_reach(shared))
    return Pruned(_placed(first.unionByName(later), k), found["visited"], asked * len(rings_.number))


# --- a recall that is asked for --------------------------------------------------


def nearest_calibrated(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    recall: float = 0.9,
    cells: int | None = None,
    border: float = 0.1,
    drawn: int = 400,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """As ``nearest_cells``, with as many cells probed as ``recall`` needs.

    Index rows whose second centre is at most ``border`` farther than the first
    are in both cells. About ``drawn`` queries, chosen by a hash of the id, are
    answered exactly; a neighbour is found if one of its cells is probed, so the places
    of those cells in the order of each query give the recall for any number
    of probes. The least number is taken that reaches ``recall`` by two
    standard errors (all cells, if none does). ``probes`` and ``measured_recall``,
    that of the drawn queries, come as columns.
    """
    spark = queries.sparkSession
    queries, asked, index, index_rows, length = _measured(queries, index)
    centres = _centres(index, index_rows, length, cells or min(MOST_CELLS, math.isqrt(index_rows)), sample_rows, seed)
    shared = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("array<int>")
    def homes(vectors: pa.Array) -> pa.Array:
        points, out = _matrix(vectors), []
        for start in range(0, len(points), _BLOCK):
            away = _distances(points[start : start + _BLOCK], shared.value)
            order = np.argsort(away, axis=1, kind="stable")[:, :2]
            near = np.take_along_axis(away, order, axis=1)
            out += [cells[: 1 + int(len(cells) > 1 and d[1] <= (1.0 + border) * d[0])] for cells, d in zip(order, near, strict=True)]
        return _lists(out)

    index = materialize(index.withColumn("_homes", homes("index_vector")), "index-cells")
    range_ = 1 << 40
    chosen = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(range_)) < int(range_ * min(1.0, drawn / max(1, asked)))
    some = queries.where(chosen)
    order = _cells_of(spark, centres, len(centres))
    truth = nearest(some.withColumnRenamed("query_vector", "vector"), index.withColumnRenamed("index_vector", "vector"), k)
    # About ``drawn`` queries with k rows each.
    truth = materialize(truth.select("query_id", F.col("id").alias("_id")), "truth")
    ranks = (
        index.join(F.broadcast(truth), F.col("id") == F.col("_id"))
        .join(some.select(F.col("query_id").alias("_asked"), order("query_vector").alias("_order")), F.col("query_id") == F.col("_asked"))
        .select(F.array_min(F.transform("_homes", lambda cell: F.array_position("_order", cell))).alias("rank"))
    )
    # At most one row a cell.
    counts = sorted((row["rank"], row["count"]) for row in ranks.groupBy("rank").count().collect())
    total, found = sum(n for _, n in counts), 0
    probes, measured = len(centres), 1.0
    for rank, n in counts:
        found += n
        share = found / total
        if share - 2.0 * math.sqrt(share * (1.0 - share) / total) >= recall:
            probes, measured = int(rank), share
            break
    held = index.withColumn("_cell", F.explode("_homes")).drop("_homes")
    groups = _Groups(spark, *_held(held, centres), length)
    probing = queries.withColumn("_probed", _cells_of(spark, centres, probes)("query_vector"))
    hits = _meet(materialize(_shared_out(probing, groups, "_probed"), "query-cells"), held, groups, k, twice=True)
    # A row in cells of two groups is found twice, at the same distance.
    return _placed(hits.dropDuplicates(["query_id", "id"]), k).select(
        "*", F.lit(probes).alias("probes"), F.lit(measured).alias("measured_recall")
    )


def retrieve(hits: DataFrame, index: DataFrame, key: str = "ticket_id") -> DataFrame:
    """One row per query with its examples, nearest first, as ``retrieved``.

    ``index`` has id, category, priority, customer_message, resolution_text.
    Many queries may hit one index row, so that join is salted.
    """
    texts = index.select(
        F.col("id").alias("_id"), "category", "priority", "customer_message", "resolution_text"
    )
    example = F.struct(
        "place",
        F.struct(
            F.col("id").cast("string").alias("ticket_id"),
            "category", "priority", "customer_message", "resolution_text", "distance",
        ).alias("example"),
    )
    return (
        salted_join(hits, texts, "id", "_id", spread=F.col("query_id"))
        .groupBy(F.col("query_id").alias(key))
        .agg(F.array_sort(F.collect_list(example)).alias("_examples"))
        .select(key, F.transform("_examples", lambda e: e["example"]).alias("retrieved"))
    )
