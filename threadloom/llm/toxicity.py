"""Toxicity of documents by their nearest labelled examples.

Examples and documents are TF-IDF vectors over terms that tell the labels
apart. The nearest examples by cosine are found exactly, over an inverted index
whose postings are cut into blocks of examples; each block of a term keeps its
largest weight. The sum of those bounds what any example of the block can
reach, so blocks are read from the highest bound on, until no bound reaches the
last of the nearest. Neighbours vote by distance, and a step function fitted to
the votes that the examples get from each other turns votes into chances. The
neighbours come along as evidence.

Only the examples are bounded: at most ``EXAMPLES`` of each label, the first by
hash of their id. How often a term occurs is counted over all documents, and
every document is scored by its whole text.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import NUMBER_BATCH, batches, fold
from threadloom.sources.tables import materialize, materialize_counted

FOLDS, HELD_OUT = 4, 2
# Examples of each label, and terms, at most: bounds of what reaches the driver and every task.
EXAMPLES = 4_000
TERMS = 20_000
# Examples that a term occurs in, at least, and the chance that any term without
# a bearing on the label is taken, over all terms together.
LEAST_EXAMPLES = 3
CHANCE = 0.01
# How strongly a term goes with the label, at least: the phi coefficient, where 0.1 is by
# convention a small effect. Chance alone would let ever weaker terms in as examples get more.
EFFECT = 0.1
NEIGHBOURS = 11
BLOCK = 64
# Added to a distance, so that equal texts do not outvote all others.
NEAR = 0.05
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 20_000

EVIDENCE = "array<struct<doc_id: long, label: int, similarity: double>>"


def terms_of(text: str | None) -> Counter[str]:
    """Lower-case runs of letters of a whole text, with their counts; none for NULL."""
    return Counter(_WORD.findall((text or "").lower()))


def least_chi_square(terms: int) -> float:
    """Chi-square, one degree of freedom, that chance passes for any of so many terms at ``CHANCE``."""
    low, high = 0.0, 1_000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) * max(1, terms) > CHANCE else (low, middle)
    return high


class BlockMaxIndex:
    """Postings of unit vectors by term, in blocks of ``block`` vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, block: int = BLOCK):
        """``vectors`` are (terms, weights); those without terms are near nothing and stay out."""
        kept = [i for i, (terms, _) in enumerate(vectors) if len(terms)]
        # Vectors with the same heaviest term go together, so that bounds are tight.
        heaviest = [(int(vectors[i][0][vectors[i][1].argmax()]), -float(vectors[i][1].max()), i) for i in kept]
        self.places = np.array([i for *_, i in sorted(heaviest)], np.int64)
        self.ids, self.block = ids[self.places] if len(kept) else np.empty(0, np.int64), block
        self.blocks = -(-len(kept) // block)
        found: dict[int, list[tuple[int, float]]] = {}
        for at, i in enumerate(self.places.tolist()):
            for term, weight in zip(*vectors[i], strict=True):
                found.setdefault(int(term), []).append((at, float(weight)))
        # Of each term: places, weights, blocks that have it, where they start, and their largest weights.
        self.postings = {}
        for term, rows in found.items():
            at, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            blocks, starts = np.unique(at // block, return_index=True)
            stops = [*starts[1:].tolist(), len(at)]
            spans = dict(zip(blocks.tolist(), zip(starts.tolist(), stops, strict=True), strict=True))
            self.postings[term] = (at % block, weight, blocks, spans, np.maximum.reduceat(weight, starts))
        self.read = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None) -> list[tuple[float, int]]:
        """(cosine, place among ``vectors``) of the k nearest, ties to the smaller id; only positive cosines.

        ``skip`` is the place of a vector that takes no part.
        """
        query = [(self.postings[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in self.postings]
        if not query:
            return []
        bounds = np.zeros(self.blocks)
        for (_, _, blocks, _, largest), weight in query:
            bounds[blocks] += weight * largest
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            # A sum of products rounds no higher than the sum of larger products in the same order.
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < -best[-1][0]):
                break
            self.read += 1
            scores = np.zeros(self.block)
            for (at, own, _, spans, _), weight in query:
                if b in spans:
                    start, stop = spans[b]
                    scores[at[start:stop]] += weight * own[start:stop]
            limit = -best[-1][0] if len(best) == k else 0.0
            for at in np.flatnonzero((scores >= limit) & (scores > 0)).tolist():
                place = b * self.block + at
                if self.places[place] != skip:
                    best.append((-float(scores[at]), int(self.ids[place]), int(self.places[place])))
            best = sorted(best)[:k]
        return [(-score, place) for score, _, place in best]


def isotonic(votes: list[float], labels: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from this vote on, chance): pooled until they rise, then drawn towards the common share by the weight of one row."""
    if not votes:
        return np.empty(0), np.empty(0)
    share = float(np.average(labels, weights=weights))
    pools: list[list[float]] = []  # vote, positive weight, weight
    for vote, label, weight in sorted(zip(votes, labels, weights, strict=True)):
        if pools and pools[-1][0] == vote:
            pools[-1][1] += label * weight
            pools[-1][2] += weight
        else:
            pools.append([vote, label * weight, weight])
    merged: list[list[float]] = []
    for pool in pools:
        merged.append(pool)
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            _, positive, weight = merged.pop()
            merged[-1][1] += positive
            merged[-1][2] += weight
    one = float(np.mean(weights))
    return np.array([m[0] for m in merged]), np.array([(m[1] + one * share) / (m[2] + one) for m in merged])


@dataclass
class Model:
    """Terms with their idf, the examples, and the steps from votes to chances."""

    places: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    # How many labelled rows an example stands for.
    shares: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = (np.empty(0), np.empty(0))
    # Chance of a text without neighbours.
    alone: float = 0.0

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF weights."""
        weights = (1.0 + np.log(counts)) * self.idf[terms]
        return weights / (np.sqrt((weights * weights).sum()) or 1.0)

    def neighbours(self, terms: np.ndarray, counts: np.ndarray, skip: int | None = None) -> list[tuple[float, int]]:
        return self.index.nearest(terms, self.vector(terms, counts), NEIGHBOURS, skip)

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        """Share of the neighbours' votes for label 1; None without neighbours."""
        if not near:
            return None
        weight = [self.shares[i] / (max(0.0, 1.0 - s) + NEAR) for s, i in near]
        return float(sum(w for w, (_, i) in zip(weight, near, strict=True) if self.labels[i]) / sum(weight))

    def chance(self, vote: float | None) -> float:
        if vote is None or not len(self.steps[0]):
            return self.alone
        return float(self.steps[1][max(0, int(np.searchsorted(self.steps[0], vote, side="right")) - 1)])


# --- Spark --------------------------------------------------------------------


def example_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``id``, ``label`` and ``text`` of the examples, and the labelled rows of each label.

    Labels of the held-out fold and NULL labels have no part. A document with
    several labels is toxic if one says so; a repeated document counts once, by its least text.
    """
    marked, found = materialize_counted(
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("label")),
        "labels",
        ones=F.sum("label"),
        rows=F.count(F.lit(1)),
    )
    chosen = None
    for label in (0, 1):
        first = marked.where(F.col("label") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(EXAMPLES)
        chosen = first if chosen is None else chosen.union(first)
    # At most 2 * EXAMPLES rows of two numbers.
    texts = (
        docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
        .groupBy("id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
    )
    return texts.select("id", "label", "text"), {1: found["ones"], 0: found["rows"] - found["ones"]}


def _term_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        counted = [terms_of(t.as_py()) for t in frame["text"]]
        yield pa.RecordBatch.from_arrays(
            [frame["id"], frame["label"], pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))],
            ["id", "label", "terms", "counts"],
        )


def telling_terms(examples: DataFrame, sizes: dict[int, int]) -> list[str]:
    """Terms that go with the label, beyond chance by chi-square and by at least ``EFFECT``; the strongest ``TERMS`` at most, sorted."""
    ones, rows = sizes[1], sizes[0] + sizes[1]
    counted = materialize(
        examples.select(F.explode("terms").alias("term"), "label")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
        .where(F.col("n") >= LEAST_EXAMPLES),
        "terms",
    )
    n, a = F.col("n").cast("double"), F.col("ones").cast("double")
    expected = n * (ones / max(1, rows))
    spread = expected * (1 - ones / max(1, rows)) * (1 - n / max(1, rows))
    strong = counted.withColumn("chi", F.when(spread > 0, (a - expected) * (a - expected) / spread).otherwise(F.lit(0.0))).where(
        (F.col("chi") > least_chi_square(counted.count())) & (F.col("chi") >= EFFECT * EFFECT * rows)
    )
    return sorted(r["term"] for r in strong.orderBy(F.col("chi").desc(), "term").limit(TERMS).collect())


def term_hits(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """Every row of ``docs`` as doc_id, held_out, and the chosen terms it has (``terms``, ``counts``)."""
    places = {term: at for at, term in enumerate(terms)}

    def hits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            counted = [
                sorted(Counter(places[w] for w in _WORD.findall(t.as_py().lower()) if w in places).items()) for t in frame["text"]
            ]
            yield pa.RecordBatch.from_arrays(
                [frame["doc_id"], frame["held_out"], *(pa.array([[p[i] for p in c] for c in counted], pa.list_(pa.int32())) for i in (0, 1))],
                ["doc_id", "held_out", "terms", "counts"],
            )

    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (fold(f"`{key}`", FOLDS) == HELD_OUT).alias("held_out"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(hits, "doc_id long, held_out boolean, terms array<int>, counts array<int>")


def _frequencies(terms: int):
    """How many rows have each term, a row for each term and task."""

    def frequencies(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms, np.int64)
        for frame in frames:
            # A row has a term once.
            counts += np.bincount(frame["terms"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=terms)
        known = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array(counts[known], pa.int64())], ["term", "n"])

    return frequencies


def _numbers(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.array(row, kind) for row in column.to_pylist()]


def train(spark: SparkSession, examples: DataFrame, sizes: dict[int, int], terms: list[str], hits: DataFrame, rows: int) -> Model:
    """Index the examples and fit the steps. ``hits`` is the table of all documents, of ``rows`` rows."""
    df = np.zeros(len(terms))
    # At most TERMS rows.
    for row in hits.select("terms").mapInArrow(_frequencies(len(terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row["term"]] = row["n"]
    places = {term: at for at, term in enumerate(terms)}

    def known(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            pairs = [
                sorted((places[t], n) for t, n in zip(names, counts, strict=True) if t in places)
                for names, counts in zip(frame["terms"].to_pylist(), frame["counts"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [frame["id"], frame["label"], *(pa.array([[p[i] for p in row] for row in pairs], pa.list_(pa.int32())) for i in (0, 1))],
                ["id", "label", "terms", "counts"],
            )

    schema = "id long, label int, terms array<int>, counts array<int>"
    stored = materialize(examples.mapInArrow(known, schema), "examples")
    found = sorted(stored.collect(), key=lambda r: r["id"])
    ids, labels = np.array([r["id"] for r in found], np.int64), np.array([r["label"] for r in found], np.int64)
    drawn = {label: int((labels == label).sum()) for label in (0, 1)}
    shares = np.array([sizes[label] / drawn[label] for label in labels.tolist()])
    model = Model(places, np.log((1.0 + rows) / (1.0 + df)) + 1.0, None, ids, labels, shares)
    vectors = []
    for r in found:
        own = np.array(r["terms"], np.int64)
        vectors.append((own, model.vector(own, np.array(r["counts"], float))))
    model.index = BlockMaxIndex(vectors, ids)
    shared = spark.sparkContext.broadcast(model)

    def votes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = {int(i): place for place, i in enumerate(model.ids)}
        for frame in frames:
            got = [
                model.vote(model.neighbours(t, c, at[i]))
                for i, t, c in zip(frame["id"].to_pylist(), _numbers(frame["terms"], np.int64), _numbers(frame["counts"], float), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([frame["label"], pa.array(got, pa.float64())], ["label", "vote"])

    own_votes = stored.mapInArrow(votes, "label int, vote double").collect()
    weight = {label: sizes[label] / drawn[label] if drawn[label] else 0.0 for label in (0, 1)}
    voted = [(r["vote"], r["label"], weight[r["label"]]) for r in own_votes if r["vote"] is not None]
    model.steps = isotonic(*map(list, zip(*voted, strict=True))) if voted else model.steps
    none = [(r["label"], weight[r["label"]]) for r in own_votes if r["vote"] is None]
    if none:
        model.alone = sum(y * w for y, w in none) / (sum(w for _, w in none) + 1.0)
    return model


def score_udf(spark: SparkSession, model: Model):
    # Bounded by EXAMPLES and TERMS.
    shared = spark.sparkContext.broadcast(model)

    def scores(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, remembered = shared.value, {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))
        for frame in frames:
            out = []
            for names, counts in zip(frame["terms"].to_pylist(), frame["counts"].to_pylist(), strict=True):
                query = (*names, -1, *counts)
                if query not in remembered:
                    near = model.neighbours(np.array(names, np.int64), np.array(counts, float)) if names else []
                    evidence = [{"doc_id": int(model.ids[i]), "label": int(model.labels[i]), "similarity": s} for s, i in near]
                    if len(remembered) >= _REMEMBERED:
                        remembered.clear()
                    remembered[query] = (model.chance(model.vote(near)), evidence)
                out.append(remembered[query])
            yield pa.RecordBatch.from_arrays(
                [frame["doc_id"], frame["held_out"], pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], kind)],
                ["doc_id", "held_out", "score", "evidence"],
            )

    return scores


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (score of at least ``least``) and ``evidence`` of every row.

    ``evidence`` lists the nearest examples, nearest first, ties to the smaller id. NULL and empty texts, and those
    without a term that tells labels apart, have no neighbours and get the share of toxic examples among such texts;
    without any labelled example all scores are 0. Repeated rows are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts, sizes = example_texts(docs, labels, key, text)
    examples, found = materialize_counted(
        texts.mapInArrow(_term_rows, "id long, label int, terms array<string>, counts array<int>"),
        "examples", ones=F.sum("label"), rows=F.count(F.lit(1)),
    )
    terms = telling_terms(examples, {1: found["ones"], 0: found["rows"] - found["ones"]})
    hits, all_rows = materialize_counted(term_hits(docs, terms, key, text), "hits", rows=F.count(F.lit(1)))
    with batches(spark, NUMBER_BATCH):
        model = train(spark, examples, sizes, terms, hits, all_rows["rows"])
    schema = f"doc_id long, held_out boolean, score double, evidence {EVIDENCE}"
    found = hits.mapInArrow(score_udf(spark, model), schema)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), "evidence")
