"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Best-fit decreasing needs only the
number of pieces of each length, a histogram no longer than the largest
permitted length, whatever the size of the corpus; bins that are filled alike are one
entry with a count. Pieces of a length then take the places planned for it by their rank.
"""

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import NUMBER_BATCH, batches, words_of
from threadloom.sources.tables import materialize

CAPACITIES = (512, 1_024, 2_048, 4_096)
# Tokens that one more sequence costs beside its own length.
OVERHEAD = 16


@dataclass
class Plan:
    """Runs: ``n`` pieces of ``length``, from ``rank`` on, go one each to the bins
    from ``bin`` on, at ``start``. Sizes: bins from ``first`` on have ``capacity``."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    start: np.ndarray
    first: np.ndarray
    capacity: np.ndarray
    bins: int


def cost(capacity: int, overhead: int = OVERHEAD) -> int:
    return capacity + overhead


def _opening(length: int, waiting: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The permitted length with the least cost for what will be in it: a bin
    is charged for the share that the pieces still waiting cannot fill."""
    price = min(cost(c, overhead) / c for c in capacities)
    fitting = [c for c in capacities if c >= length]
    return min(fitting, key=lambda c: (cost(c, overhead) - price * min(c - length, waiting) - price * length, c))


def plan_bins(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """Best fit, longest pieces first, over a histogram of lengths (1 to the largest capacity)."""
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    runs: list[tuple[int, int, int, int]] = []
    # By free room: stacks of (first bin, bins, capacity); rooms in order.
    groups: dict[int, list[tuple[int, int, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, int, int, int]] = []
    bins = 0
    waiting = sum(length * n for length, n in counts.items())

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append(group)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 1 <= length <= capacities[-1]:
            raise ValueError(f"no permitted length holds {length}")
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, size, capacity = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                capacity = room = _opening(length, waiting - length, capacities, overhead)
                # As many bins of this kind as the pieces fill, one with a rest apart.
                first, size = bins, max(1, left // (room // length))
                bins += size
            each = room // length
            if left >= size * each:
                used, slots = size, each
            elif left >= each:
                used, slots = left // each, each
            else:
                used, slots = 1, left
            if used < size:
                put(room, (first + used, size - used, capacity))
            start = capacity - room
            for slot in range(slots):
                runs.append((length, rank, first, start + slot * length))
                rank += used
            left -= used * slots
            waiting -= used * slots * length
            rest = room - slots * length
            if rest:
                put(rest, (first, used, capacity))
            else:
                done.append((first, used, capacity, 0))
    for room, stack in groups.items():
        done += [(first, size, capacity, room) for first, size, capacity in stack]
    done.sort()
    # Each bin comes down to the smallest permitted length that holds its contents.
    final = [min(c for c in capacities if c >= capacity - room) for _, _, capacity, room in done]
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(*table.T, np.array([d[0] for d in done], np.int64), np.array(final, np.int64), bins)


# --- Spark --------------------------------------------------------------------


def word_tokens(text: Column) -> Column:
    """Words and one end of text."""
    return F.size(words_of(text)) + 1


def pieces(docs: DataFrame, tokens: Column, largest: int, keep: Column) -> DataFrame:
    """One row per piece: ``row`` (``keep``), piece, first_token, n_tokens. A document longer than
    the largest sequence is cut into full pieces and a rest; no token is left out."""
    counted = docs.select(keep.alias("row"), F.greatest(tokens.cast("long"), F.lit(1)).alias("tokens"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / largest)))
    return counted.withColumn("piece", piece).select(
        "row",
        "piece",
        (F.col("piece") * largest).alias("first_token"),
        F.least(F.lit(largest), F.col("tokens") - F.col("piece") * largest).cast("long").alias("n_tokens"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``part``, a task's number, and ``nth``, the place of the row among
    those of its length in that task."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in ("part", "nth"))])

    def number(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for frame in frames:
            places = []
            for length in frame["n_tokens"].to_pylist():
                place = seen.get(length, 0)
                seen[length] = place + 1
                places.append(place)
            columns = [*frame.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*frame.schema.names, "part", "nth"])

    return rows.mapInArrow(number, schema)


def packed(
    docs: DataFrame,
    tokens: Column,
    keep: Column,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
) -> DataFrame:
    """``row`` (``keep``), piece, first_token, n_tokens, bin_id, capacity and position of every piece.

    A NULL or empty text is one piece, its end. Repeated rows are packed each. An
    empty table gives no rows. The bins are the same under any partitioning, up
    to which of equally long pieces takes which place.
    """
    spark = docs.sparkSession
    with batches(spark, NUMBER_BATCH):
        rows = materialize(_numbered(pieces(docs, tokens, max(capacities), keep)), "pieces")
    share = rows.groupBy("part", "n_tokens").agg(F.max("nth").alias("last"))
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = share.select(
        F.col("part").alias("base_part"),
        F.col("n_tokens").alias("base_tokens"),
        F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base"),
    )
    # One row per length, and no length is over the largest capacity.
    histogram = {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(histogram, capacities, overhead)
    on = (F.col("part") == F.col("base_part")) & (F.col("n_tokens") == F.col("base_tokens"))
    ranked = rows.join(base, on).select(
        "row", "piece", "first_token", "n_tokens", (F.col("nth") + F.col("base")).alias("rank")
    )
    placed = (T.StructField(n, T.LongType()) for n in ("bin_id", "capacity", "position"))
    schema = T.StructType([*ranked.schema.fields[:4], *placed])
    # Bounded by the histogram, not by the corpus.
    shared = spark.sparkContext.broadcast(plan)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        lengths, starts = np.unique(plan.length, return_index=True)
        ends = np.r_[starts[1:], len(plan.length)]
        for frame in frames:
            own, rank = frame["n_tokens"].to_numpy(), frame["rank"].to_numpy()
            run = np.empty(len(own), np.int64)
            for length in np.unique(own):
                mine = np.flatnonzero(own == length)
                at = int(np.searchsorted(lengths, length))
                low, high = starts[at], ends[at]
                run[mine] = low + np.searchsorted(plan.rank[low:high], rank[mine], side="right") - 1
            bins = plan.bin[run] + rank - plan.rank[run]
            size = plan.capacity[np.searchsorted(plan.first, bins, side="right") - 1]
            columns = [frame[c] for c in ("row", "piece", "first_token", "n_tokens")]
            columns += [pa.array(bins), pa.array(size), pa.array(plan.start[run])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES
) -> DataFrame:
    """The places of all documents: doc_id, piece, first_token, n_tokens, bin_id, capacity, position."""
    found = packed(docs, word_tokens(F.col(f"`{text}`")), F.struct(F.col(f"`{key}`").cast("long").alias("doc_id")), capacities)
    return found.select("row.doc_id", "piece", "first_token", "n_tokens", "bin_id", "capacity", "position")
