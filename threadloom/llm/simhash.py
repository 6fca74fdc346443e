"""SimHash near duplicates, compared in bit slices.

Fingerprints that differ in few bits share some part of their bits exactly.
With ``radius`` 3 one of four 16-bit blocks is equal, and one of four 12-bit
blocks of the other 48 bits too, so every linked pair meets under one of 16 keys
of 28 bits. Distinct fingerprints under one key are compared in bit slices:
64 bit planes stand vertically, one machine word holds one bit of 64
fingerprints, and carry-save counters add up 64 distances at a time. Such a block
of 64 is abandoned once all its distances are past the radius. Each pair is met
once, never a fingerprint with itself, or no block could be given up; planes that
are alike in a whole group are passed over. Exact copies are one fingerprint from the start.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import NUMBER_BATCH, batches
from threadloom.llm.components import components
from threadloom.operators.joins import salted_join, sized_join
from threadloom.sources.tables import materialize

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
# Fingerprints of one key in one comparison; a key with more is cut into tiles.
TILE = 4_096
# Planes that are added up before the first look whether blocks are past the radius, and between looks.
_FIRST_LOOK, _LOOK = 16, 8
_CHUNK = 65_536
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a whole text as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, count, _CHUNK):
        stop = min(count, start + _CHUNK)
        part = words[start : stop + size - 1]
        columns = [part[i : i + stop - start] for i in range(size)]
        shingles = map(b" ".join, zip(*columns, strict=True)) if count > 1 or len(words) == size else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, stop - start)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Eight one-byte counters to a machine word; 255 rows cannot overflow them.
        sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, stop - start, 255), axis=0)
        ones += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > count, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint_udf(size: int = SHINGLE):
    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(text.as_py(), size) for text in texts], pa.int64())

    return fingerprints


# --- bit slices ---------------------------------------------------------------


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes [64, words]: bit i of word w is the plane's bit of value 64 w + i."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    return _turned(padded.reshape(-1, 64))


def _turned(rows: np.ndarray) -> np.ndarray:
    """Planes [64, words] of the values [words, 64]."""
    bits = np.unpackbits(rows.astype("<u8").view(np.uint8).reshape(len(rows), 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0].astype(np.uint64)


def near_masks(
    queries: np.ndarray, planes: np.ndarray, radius: int, outside: np.ndarray | int = 0, order=range(BITS)
) -> np.ndarray:
    """Masks with a bit set where planes and query differ in at most ``radius`` bits.

    ``planes`` is [64, words]; ``queries`` [n, 1] for n queries against all
    words, or [words] for one query per word. Bits of ``outside`` are not looked
    at; ``order`` names the planes that can differ.
    """
    return near_blocks(queries, planes, radius, outside, order)[0]


def near_blocks(queries, planes, radius, outside=0, order=range(BITS)) -> tuple[np.ndarray, int]:
    """The masks of ``near_masks`` and the number of steps, one a block and plane.

    Counters of bit_length(radius) bits are kept per position, with an overflow bit
    that stays set. From the first look on, blocks whose every position is past the
    radius or outside are left behind, and only the others go on.
    """
    levels = max(1, int(radius).bit_length())
    shape = np.broadcast_shapes(queries.shape, planes[0].shape)
    masks, order = np.zeros(shape, np.uint64), list(order)
    counter = [np.zeros(shape, np.uint64) for _ in range(levels)]
    past = np.array(np.broadcast_to(np.asarray(outside, np.uint64), shape))
    # Blocks that go on, as places in the masks; all of them at first, not listed.
    live, words, steps = None, None, 0
    for turn, k in enumerate(order):
        if turn >= _FIRST_LOOK and (turn - _FIRST_LOOK) % _LOOK == 0:
            left = np.flatnonzero(past.ravel() != _ALL)
            if not len(left):
                return masks, steps
            if live is None or len(left) < len(live):
                if live is None:
                    words = np.broadcast_to(np.arange(planes.shape[1]), shape).ravel()
                    queries = np.broadcast_to(queries, shape).ravel()
                live = left if live is None else live[left]
                counter = [c.ravel()[left] for c in counter]
                words, queries, past = words[left], queries[left], past.ravel()[left]
        plane = planes[k] if live is None else planes[k][words]
        # All ones where the query has the bit, so that xor marks differences.
        carry = plane ^ (np.uint64(0) - ((queries >> np.uint64(k)) & _ONE))
        for level in range(levels):
            counter[level], carry = counter[level] ^ carry, counter[level] & carry
        past |= carry
        steps += past.size
    # Counters over the radius that have not overflowed: compare bit by bit.
    above, equal = np.zeros_like(past), np.full_like(past, _ALL)
    for level in reversed(range(levels)):
        if radius >> level & 1:
            equal &= counter[level]
        else:
            above |= equal & counter[level]
            equal &= ~counter[level]
    masks.ravel()[slice(None) if live is None else live] = (~(past | above)).ravel()
    return masks, steps


def _mirrored(rows: np.ndarray) -> np.ndarray:
    """Bit rows [n, words] of pairs in one order, with those of the other order too."""
    n, words = rows.shape
    both = rows.copy()
    for word in range(words):
        # Rows 64 word.. as columns: their bits, turned over, belong to that word of all rows.
        part = rows[64 * word : 64 * word + 64].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little", count=n)
        turned = np.zeros((n, 64), np.uint8)
        turned[:, : len(part)] = bits.T
        both[:, word] |= np.packbits(turned, axis=1, bitorder="little").view("<u8")[:, 0]
    return both


def _forest(neighbours, n: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest; ``neighbours(i)`` is a bit mask as a Python int."""
    left = (1 << n) - 1
    while left:
        root = (left & -left).bit_length() - 1
        left &= ~(1 << root)
        reached = [root]
        while reached and left:
            node = reached.pop()
            new = neighbours(node) & left
            left &= ~new
            while new:
                other = (new & -new).bit_length() - 1
                new &= new - 1
                reached.append(other)
                yield node, other


def _small_groups(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int):
    """Links inside many groups of at most 64, one machine word per group."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    most = int(sizes[0])
    places = np.minimum(starts[:, None] + np.arange(most), len(values) - 1)
    inside = np.arange(most) < sizes[:, None]
    table = np.zeros((len(sizes), 64), np.uint64)
    table[:, :most] = np.where(inside, values[places], 0)
    planes = _turned(table)
    # Positions after the end of a group, and those up to each query, are outside.
    ends = np.array([~((1 << size) - 1) & (1 << 64) - 1 for size in sizes.tolist()], np.uint64)
    masks = np.zeros((len(sizes), most), np.uint64)
    for i in range(most - 1):
        live = int((sizes > i + 1).sum())
        outside = ends[:live] | np.uint64((1 << i + 1) - 1)
        masks[:live, i] = near_masks(table[:live, i], planes[:, :live], radius, outside)
    for g in np.flatnonzero(masks.any(axis=1)).tolist():
        row = masks[g].tolist()
        for i in range(int(sizes[g])):
            for j in range(i):
                row[i] |= (row[j] >> i & 1) << j
        for i, j in _forest(row.__getitem__, int(sizes[g])):
            yield values[starts[g] + i], values[starts[g] + j]


def _large_group(values: np.ndarray, radius: int):
    """Links inside one group of any size up to two tiles: 64 rows at a time
    against the planes from their own word on."""
    n, planes = len(values), planes_of(values)
    differ = int(np.bitwise_or.reduce(values) & ~np.bitwise_and.reduce(values))
    order = [k for k in range(BITS) if differ >> k & 1]
    rows = np.zeros((n, planes.shape[1]), np.uint64)
    for word in range(planes.shape[1]):
        queries = values[64 * word : 64 * word + 64]
        outside = np.zeros((len(queries), planes.shape[1] - word), np.uint64)
        if n % 64:
            outside[:, -1] = _ALL << np.uint64(n % 64)
        # A row itself and those before it.
        outside[:, 0] |= _ALL >> np.arange(63, 63 - len(queries), -1, dtype=np.uint64)
        rows[64 * word : 64 * word + 64, word:] = near_masks(queries[:, None], planes[:, word:], radius, outside, order)
    if not rows.any():
        return
    masks = [int.from_bytes(m.astype("<u8").tobytes(), "little") for m in _mirrored(rows)]
    for i, j in _forest(masks.__getitem__, n):
        yield values[i], values[j]


def links_in_groups(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within the radius, inside each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = (sizes >= 2) & (sizes <= 64)
    found: list[tuple[int, int]] = []
    where, lengths = starts[small], sizes[small]
    for at in range(0, len(where), 1_024):
        found += _small_groups(values, where[at : at + 1_024], lengths[at : at + 1_024], radius)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        found += _large_group(values[start : start + size], radius)
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pairs[:, 0], pairs[:, 1]


# --- Spark --------------------------------------------------------------------


def _bits(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << width) - 1)


def block_keys(value: Column, radius: int = RADIUS) -> Column:
    """Keys one of which two fingerprints within the radius share.

    Some of radius + 1 blocks is equal, and within the other bits some of
    radius + 1 blocks again; a key is the place and content of such a pair.
    """
    parts = radius + 1
    if not 1 <= radius <= 7:
        raise ValueError("the radius is from 1 to 7 bits")
    cuts = [BITS * i // parts for i in range(parts + 1)]
    keys = []
    for i in range(parts):
        width = cuts[i + 1] - cuts[i]
        # The other bits, moved together.
        low = _bits(value, 0, cuts[i]) if cuts[i] else F.lit(0).cast("long")
        high = F.shiftrightunsigned(value, cuts[i + 1]) if cuts[i + 1] < BITS else F.lit(0).cast("long")
        rest = F.shiftleft(high, cuts[i]).bitwiseOR(low)
        inner = [(BITS - width) * j // parts for j in range(parts + 1)]
        for j in range(parts):
            body = F.shiftleft(_bits(value, cuts[i], width), inner[j + 1] - inner[j]).bitwiseOR(
                _bits(rest, inner[j], inner[j + 1] - inner[j])
            )
            keys.append(F.shiftleft(body, 6).bitwiseOR(F.lit(parts * i + j).cast("long")))
    return F.array(*keys)


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a, b between distinct fingerprints (``prints.fp``) within the radius: a
    spanning forest of each group, so that no group gives all its pairs.

    A key with more than ``tile`` fingerprints is cut into parts, and each part
    meets each other part in a task of its own; no key is dropped or cut short.
    """
    spark = prints.sparkSession
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    shared = (
        keyed.groupBy("key")
        .count()
        .where("count > 1")
        .select(F.col("key").alias("shared_key"), F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    tiles = (
        salted_join(keyed, shared, "key", "shared_key", spread=F.col("fp"))
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "fp", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
        )
        .select("fp", F.xxhash64("key", "i", "j").alias("tile"))
    )

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = links_in_groups(keys, values, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for frame in frames:
            held_keys = np.concatenate([held_keys, frame["tile"].to_numpy()])
            held = np.concatenate([held, frame["fp"].to_numpy().view(np.uint64)])
            # The last tile may go on in the next batch.
            done = int(np.searchsorted(held_keys, held_keys[-1])) if len(held_keys) else 0
            if done:
                yield found(held_keys[:done], held[:done])
                held_keys, held = held_keys[done:], held[done:]
        if len(held_keys):
            yield found(held_keys, held)

    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    with batches(spark, NUMBER_BATCH):
        return materialize(dealt.mapInArrow(compare, "a long, b long"), "near-links")


def component_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For every distinct fingerprint of ``rows`` (id, fp): ``print``, ``root``, the
    smallest fingerprint that can be reached, and ``component_id``, the smallest id."""
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(near_links(prints, radius))
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(smallest.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).select(
        F.col("fp").alias("print"), "root", "component_id"
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    NULL and empty texts have fingerprint zero and are linked like any other.
    Repeated ids and rows stay rows of their own; a NULL id counts for nothing
    when the smallest id is chosen. An empty table gives no rows.
    """
    prints = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), fingerprint_udf(size)(F.col(f"`{text}`")).alias("fp")
    )
    rows = materialize(prints, "simhash")
    joined = sized_join(rows, component_of(rows, radius), "fp", "print", spread=F.col("id"))
    return joined.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without their near copies: of each component the row with the smallest
    id stays, of repeated rows one. Columns are those of ``docs``.

    Rows are numbered as they are written, and that number tells equal rows
    apart. Rows to drop are broadcast if few, else joined by salted key.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    written = docs.select(
        row.alias("row"),
        F.col(f"`{key}`").cast("long").alias("id"),
        fingerprint_udf(size)(F.col(f"`{text}`")).alias("fp"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = materialize(written, "simhash-rows")
    groups = component_of(rows.select("id", "fp"), radius).select("print", "root")
    thin = sized_join(rows.select("id", "fp", "place"), groups, "fp", "print", spread=F.col("place"))
    thin = materialize(thin.select("root", "id", "place"), "simhash-groups")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "place")
    kept = thin.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.place").alias("kept"))
    dropped = thin.join(kept, F.col("place") == F.col("kept"), "left_anti").select(F.col("place").alias("gone"))
    return sized_join(rows.select("row", "place"), dropped, "place", "gone", "left_anti", F.col("place")).select(
        "row.*"
    )
