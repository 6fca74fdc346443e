"""Merkle manifest of a table: a digest of every row, a tree of digests for every
group, one root over the groups, and for every row the proof that it is under it.

Trees are built by time-forward processing. A node's label is the place where
its span of leaves ends, then its level, so labels of children come before that
of their parent. A digest is a message to the parent's label, and a priority
queue hands messages out in the order of labels. The queue is external: Spark's
shuffle brings the messages of a unit (``UNIT`` nodes that follow each other)
to one task and sorts them, on disk where they are many; in the task only the
messages between the inner nodes of the unit wait in a heap. One round moves a
whole table ``BAND`` levels up, so 1e12 rows take four. The way back is the
same with labels reversed: a node hands each child its own proof, with the
child's siblings before it, until every leaf has its own.

A tree with most of the rows is many units like any other; no task ever holds
more than one unit and the proof that its top was handed.
"""

import hashlib
import heapq
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.joins import sized_join
from threadloom.sources.tables import materialize, materialize_counted

FANOUT = 16
BAND = 3
UNIT = FANOUT**BAND
# Rows of digests that one task sorts.
TASK_ROWS = 400_000

PROOF = "array<struct<before: string, after: string>>"
# Bits of monotonically_increasing_id below the number of the partition.
_ROW_BITS = 33


def row_digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, each its UTF-8 byte count, ``:`` and value; ``-`` for NULL."""

    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def height(nodes: int) -> int:
    """Levels above that many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def _joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """Children's digests of every inner node of one unit, by label (end, level).

    ``digests`` are those of the unit's lowest nodes in order. The heap holds
    the messages to nodes that are not complete: at most ``FANOUT`` a level.
    """
    queue: list[tuple[int, int, int, str]] = []
    children: dict[tuple[int, int], list[str]] = {}

    def send(at: int, level: int, digest: str) -> None:
        if level < levels:
            span = FANOUT ** (level + 1)
            heapq.heappush(queue, ((at // FANOUT + 1) * span, level + 1, at % FANOUT, digest))

    def deliver(upto: int | None) -> None:
        while queue and (upto is None or queue[0][0] <= upto):
            end, level = queue[0][:2]
            got = children[end, level] = []
            while queue and queue[0][:2] == (end, level):
                got.append(heapq.heappop(queue)[3])
            send(end // FANOUT**level - 1, level, _joined(got))

    for at, digest in enumerate(digests):
        deliver(at)
        send(at, 0, digest)
    deliver(None)
    return children


def sweep_down(children: dict[tuple[int, int], list[str]], count: int, levels: int, suffix: tuple) -> list[tuple]:
    """Proofs of the lowest nodes of one unit, whose top was handed ``suffix``.

    A proof is a tuple of (digests before, digests after), from the node up.
    """
    proofs: list[tuple] = [suffix] * count
    # Labels reversed: the top first, every node before its children.
    queue = [(-(FANOUT**levels), -levels, suffix)] if levels else []
    while queue:
        end, level, proof = heapq.heappop(queue)
        end, level = -end, -level
        digests, span = children[end, level], FANOUT ** (level - 1)
        first = end // span - FANOUT
        for slot in range(len(digests)):
            step = ("".join(digests[:slot]), "".join(digests[slot + 1 :]))
            if level == 1:
                proofs[first + slot] = (step, *proof)
            else:
                heapq.heappush(queue, (-(first + slot + 1) * span, 1 - level, (step, *proof)))
    return proofs


# --- Spark --------------------------------------------------------------------


def _tasks(df: DataFrame, rows: int) -> int:
    """Partitions for that many digests. A given number is not merged by adaptive execution."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(rows / TASK_ROWS), min(slots, rows // UNIT))


def ranked(rows: DataFrame, count: int, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in its tree from 0 by ``order``, and ``n``, the rows of the tree.

    Rows are sorted once over all tasks, and the counts of each tree in each
    task give the places; no tree has to be in one task. Rows equal in all of
    ``order`` stand in any order.
    """
    spread = rows.repartitionByRange(_tasks(rows, count), tree, *order).sortWithinPartitions(tree, *order)
    # The id is written at once, so it stays; within a task it counts rows in order.
    placed = materialize(spread.withColumn("_id", F.monotonically_increasing_id()), "sorted").withColumn(
        "_key",
        F.concat(
            F.shiftright("_id", _ROW_BITS).cast("string"), F.lit(":"),
            F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit("-")),
        ),
    )
    spans = placed.groupBy("_key").agg(
        F.first(tree).alias("_tree"), F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    # One row per task and tree: a tree has at most as many as there are tasks.
    by_tree = Window.partitionBy("_tree")
    spans = spans.select(
        F.col("_key").alias("_span"),
        (F.sum("_size").over(by_tree.orderBy("_first")) - F.col("_size") - F.col("_first")).alias("_shift"),
        F.sum("_size").over(by_tree).alias("n"),
    )
    return sized_join(placed, spans, "_key", "_span", spread=F.col("_id")).select(
        *rows.columns, (F.col("_id") + F.col("_shift")).alias("at"), "n"
    )


def _queued(messages: DataFrame, rows: int, at: Column):
    """Messages by unit, each unit's in the order of labels."""
    dealt = messages.withColumn("unit", F.expr(f"at div {UNIT}"))
    ordered = dealt.repartition(_tasks(messages, rows), "tree", "unit").sortWithinPartitions("tree", "unit", at)
    return ordered.groupBy("tree", "unit")


def _band_up(base: DataFrame, rows: int) -> DataFrame:
    """One row per unit: its top, a node of the next band."""

    def kernel(unit: pa.Table) -> pa.Table:
        digests, n = unit["digest"].to_pylist(), unit["n"][0].as_py()
        levels = min(BAND, height(n))
        top = digests[0]
        if levels:
            top = _joined(sweep_up(digests, levels)[FANOUT**levels, levels])
        return pa.table(
            {"tree": unit["tree"][:1], "at": unit["unit"][:1], "digest": [top], "n": pa.array([-(-n // FANOUT**levels)], pa.int64())}
        )

    messages = base.select("tree", "at", "digest", "n")
    return _queued(messages, rows, F.col("at").asc()).applyInArrow(kernel, "tree string, at long, digest string, n long")


def _band_down(base: DataFrame, rows: int, handed: DataFrame) -> DataFrame:
    """``base`` with ``subroot`` and ``proof`` of every node, from those of the tops of its units."""
    names = base.columns

    def kernel(unit: pa.Table) -> pa.Table:
        # The top's message comes first, then the nodes from the last to the first.
        message, nodes = unit.slice(0, 1), unit.slice(1).select(names)
        nodes = nodes.take(pa.array(range(len(nodes) - 1, -1, -1), pa.int64()))
        digests = nodes["digest"].to_pylist()
        levels = min(BAND, height(nodes["n"][0].as_py()))
        suffix = tuple((step["before"], step["after"]) for step in message["proof"][0].as_py())
        proofs = sweep_down(sweep_up(digests, levels), len(digests), levels, suffix)
        steps = [step for proof in proofs for step in proof]
        offsets = [0]
        for proof in proofs:
            offsets.append(offsets[-1] + len(proof))
        sides = [pa.array([step[side] for step in steps], pa.string()) for side in (0, 1)]
        lists = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, ["before", "after"])
        )
        subroots = pa.array(message["subroot"].to_pylist() * len(digests), pa.string())
        return nodes.append_column("subroot", subroots).append_column("proof", lists)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema)}, subroot string, proof {PROOF}"
    nodes = base.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(PROOF).alias("proof"))
    # A top's message has the first place of its unit, and goes before all of it.
    tops = handed.select(
        *(
            F.col("tree") if c == "tree" else (F.col("at") * UNIT).alias("at") if c == "at"
            else F.lit(None).cast(base.schema[c].dataType).alias(c)
            for c in names
        ),
        "subroot",
        "proof",
    )
    order = F.when(F.col("digest").isNull(), F.lit(-1)).otherwise(UNIT - F.col("at") % UNIT).asc()
    return _queued(nodes.unionByName(tops), rows, order).applyInArrow(kernel, schema)


@dataclass
class Forest:
    """Bands of nodes, lowest first, each a table with its rows; the last has the root of each tree."""

    bands: list[tuple[DataFrame, int]]

    def proofs(self, handed: DataFrame) -> DataFrame:
        """The lowest band with subroot and proof. ``handed`` has tree, subroot and proof of the tree's root."""
        handed = handed.withColumn("at", F.lit(0).cast("long"))
        for place, (base, rows) in reversed(list(enumerate(self.bands[:-1]))):
            handed = _band_down(base, rows, handed)
            if place:
                handed = materialize(handed.select("tree", "at", "subroot", "proof"), "proofs")
        return handed


def grow(base: DataFrame) -> Forest:
    """Trees over ``base``: tree, at, digest, n and any columns besides."""
    base, found = materialize_counted(base, "nodes", rows=F.count(F.lit(1)), most=F.max("n"))
    bands, most = [(base, found["rows"])], found["most"]
    while True:
        base, found = materialize_counted(
            _band_up(*bands[-1]), "nodes", rows=F.count(F.lit(1)), most=F.max("n")
        )
        bands.append((base, found["rows"]))
        # One band at least, so that single leaves are handed their proofs like others.
        if found["most"] <= 1:
            return Forest(bands)


@dataclass
class Manifest:
    """``root`` of all, None for an empty table; ``subroots`` of the trees (tree, digest); the trees."""

    root: str | None
    trees: Forest
    groups: Forest
    columns: list[str]

    @property
    def subroots(self) -> DataFrame:
        return self.trees.bands[-1][0].select("tree", "digest")

    def proofs(self) -> DataFrame:
        """Every row with ``subroot`` and ``proof``: for each level from the leaf to the root the
        digests of its siblings before and after it, as hex text put together."""
        start = self.groups.bands[-1][0].select("tree", F.lit(None).cast("string").alias("subroot"), F.array().cast(PROOF).alias("proof"))
        groups = materialize(self.groups.proofs(start), "proofs")
        handed = groups.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "proof")
        return self.trees.proofs(handed).select(*self.columns, "subroot", "proof")


def manifest(rows: DataFrame, key: str, tree: str, digest: str) -> Manifest:
    """Manifest of a table whose column ``digest`` holds the rows' digests.

    There is one tree for each value of ``tree``, NULL like any other and first;
    its leaves ascend by ``key`` (NULL first), then by digest. Repeated rows are leaves each. ``FANOUT`` nodes in
    order become one, the last fewer, until one is left; a lone leaf is its
    tree's root. An empty table has no root and no proofs. Columns of ``rows``
    are kept in a struct of their own, so any name may occur.
    """
    leaves, found = materialize_counted(
        rows.select(
            F.col(f"`{tree}`").cast("string").alias("tree"),
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{digest}`").alias("digest"),
            F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"),
        ),
        "leaves",
        rows=F.count(F.lit(1)),
    )
    trees = grow(ranked(leaves, found["rows"], "tree", ["key", "digest"]).drop("key"))
    roots, count = trees.bands[-1]
    named = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    groups = grow(ranked(named, count, "tree", ["name"]))
    top = groups.bands[-1][0].select("digest").first()
    return Manifest(top["digest"] if top else None, trees, groups, ["row"])


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, from left to right."""
    sides = F.flatten(F.transform(proof, lambda step: F.array(step["before"], step["after"])))
    return F.sha2(F.array_join(sides, ""), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a row's digest and its proof lead to."""
    return F.aggregate(
        proof, digest, lambda below, step: F.sha2(F.concat(step["before"], below, step["after"]), 256)
    )


def checked_documents(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` and the check of every row against its root.

    A leaf is the digest of doc_id, source, lang, n_chars and text; trees are by
    source. Every fifth document by crc32 of its id comes back with the capitals
    of its text lowered, and is folded as such; a NULL id is never among them.
    Gives doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.when(F.coalesce(tampered, F.lit(False)), F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select(
        "doc_id",
        "source",
        row_digest(*head, F.col("text")).alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)), row_digest(*head, lowered)).alias("changed"),
    )
    made = manifest(rows, "doc_id", "source", "leaf")
    root = F.lit(made.root).cast("string")
    return (
        made.proofs()
        .select(
            "row.doc_id", "row.leaf", "subroot", root.alias("root"),
            proof_digest(F.col("proof")).alias("proof_sha256"),
            folded(F.coalesce("row.changed", "row.leaf"), F.col("proof")).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
