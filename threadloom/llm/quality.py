"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features, those of the lines before and after,
and the states of neighbouring lines decide; the marginals of the
forward-backward pass, weighted by the length of each line, add up to the quality of the document.
Training lines take the label of their document.
"""

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fold

FOLDS, HELD_OUT = 3, 1
# Labelled documents that the model is fitted on, at most, and lines of each: bounds of what
# reaches the driver. A text with more lines gives stretches of them from all its length.
SAMPLE = 3_000
LINES, STRETCH = 1_024, 64
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"
_STOPS = b".,;:"
_HIGH = bytes(range(128, 256))
_KINDS = (_UPPER, _LOWER, _DIGITS, _SYMBOLS, _MARKS, _STOPS, _HIGH)
OWN = len(_KINDS) + 8
# Own features, those of the neighbours, and whether there are neighbours.
WIDTH = 3 * OWN + 2


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features [lines, WIDTH] and lengths in bytes. NULL and empty texts are one empty line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    rows, sizes, seen = [], [], set()
    for line in lines:
        size = len(line)
        words = line.split()
        n = len(words)
        row = [(size - len(line.translate(None, kind))) / (size or 1) for kind in _KINDS]
        repeats = sum(map(eq, words, words[1:])) if n > 1 else 0
        row += [
            1.0,
            float(n == 0),
            math.log1p(n) / 5.0,
            math.log1p(size / n) / 2.0 if n else 0.0,
            repeats / n if n else 0.0,
            len(set(words)) / math.sqrt(n) / 10.0 if n else 0.0,
            1.0 - len(set(words)) / n if n else 0.0,
            float(n > 0 and line in seen),
        ]
        seen.add(line)
        rows.append(row)
        sizes.append(size)
    own = np.array(rows, np.float32)
    features = np.zeros((len(lines), WIDTH), np.float32)
    features[:, :OWN] = own
    features[1:, OWN : 2 * OWN] = own[:-1]
    features[:-1, 2 * OWN : 3 * OWN] = own[1:]
    features[1:, 3 * OWN] = 1.0
    features[:-1, 3 * OWN + 1] = 1.0
    return features, np.array(sizes, np.float64)


def drawn_lines(features: np.ndarray, lines: int = LINES, stretch: int = STRETCH) -> np.ndarray:
    """All lines of a text, or of a longer one stretches of neighbouring lines, evenly
    spaced from its first line to its last. All lines of a text bear one label, so the seams
    between stretches are steps like any other."""
    if len(features) <= lines:
        return features
    starts = np.linspace(0, len(features) - stretch, lines // stretch).astype(int)
    return features[(starts[:, None] + np.arange(stretch)).ravel()]


class LineField:
    """Two-state chain. ``weights`` give the score of good over bad for a line;
    ``moves`` [2, 2] the scores of (state, next state)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Probability of good for each line of one text, by forward-backward."""
        good = np.exp(np.clip(scores, -30.0, 30.0)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        forward, b, g = [], 1.0, good[0]
        forward.append((b, g))
        for odds in good[1:]:
            b, g = b * bb + g * gb, (b * bg + g * gg) * odds
            total = b + g
            b, g = b / total, g / total
            forward.append((b, g))
        out = [0.0] * len(good)
        b = g = 1.0
        for at in range(len(good) - 1, -1, -1):
            fb, fg = forward[at]
            out[at] = fg * g / (fb * b + fg * g)
            step = good[at]
            b, g = bb * b + bg * step * g, gb * b + gg * step * g
            total = b + g
            b, g = b / total, g / total
        return np.array(out)

    def quality(self, text: str | None) -> float:
        """Marginals of the lines weighted by their lengths; every line counts one byte
        more than it has, so that an empty text has a value too."""
        features, sizes = line_features(text)
        marginals = self.marginals(features @ self.weights)
        return float(np.average(marginals, weights=sizes + 1.0))


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 60, penalty: float = 1e-4) -> LineField:
    """Maximum likelihood of the line labels by Adam over batches of padded texts.

    Without both labels the field has no evidence and gives one half.
    """
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    if len({label for _, label in documents}) < 2:
        return LineField(weights, moves)
    documents = sorted(documents, key=lambda d: len(d[0]))
    share = np.mean([label for _, label in documents])
    groups = [documents[i : i + 64] for i in range(0, len(documents), 64)]
    padded = []
    for group in groups:
        longest = max(len(x) for x, _ in group)
        x = np.zeros((len(group), longest, WIDTH))
        inside = np.zeros((len(group), longest))
        y = np.array([label for _, label in group], np.float64)
        for i, (own, _) in enumerate(group):
            x[i, : len(own)], inside[i, : len(own)] = own, 1.0
        # Both labels weigh the same, and a text as much as any other.
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / inside.sum(axis=1)
        padded.append((x, inside, y, weight))
    first = [np.zeros(WIDTH + 4) for _ in range(2)]
    state = np.concatenate([weights, moves.ravel()])
    rng, step = np.random.default_rng(0), 0
    for turn in range(rounds):
        for at in rng.permutation(len(padded)):
            step += 1
            gradient = _gradient(state, *padded[at]) + penalty * state
            first[0] = 0.9 * first[0] + 0.1 * gradient
            first[1] = 0.999 * first[1] + 0.001 * gradient**2
            rate = 0.05 / (1 + turn / 10)
            state = state - rate * (first[0] / (1 - 0.9**step)) / (np.sqrt(first[1] / (1 - 0.999**step)) + 1e-8)
    return LineField(state[:WIDTH].copy(), state[WIDTH:].reshape(2, 2).copy())


def _gradient(state, x, inside, y, weight):
    """Gradient of the mean negative log likelihood, all texts of a batch at once."""
    weights, moves = state[:WIDTH], np.exp(state[WIDTH:].reshape(2, 2))
    texts, longest, _ = x.shape
    emit = np.ones((texts, longest, 2))
    emit[:, :, 1] = np.exp(np.clip(x @ weights, -30.0, 30.0))
    forward, backward = np.zeros((texts, longest, 2)), np.ones((texts, longest, 2))
    forward[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        now = (forward[:, t - 1] @ moves) * emit[:, t]
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        now = (backward[:, t + 1] * emit[:, t + 1]) @ moves.T
        now /= now.sum(axis=1, keepdims=True)
        backward[:, t] = np.where(inside[:, t + 1, None] > 0, now, 1.0)
    marginal = forward * backward
    marginal /= marginal.sum(axis=2, keepdims=True)
    pull = (marginal[:, :, 1] - y[:, None]) * inside * weight[:, None]
    toward = np.zeros((2, 2))
    if longest > 1:
        pair = forward[:, :-1, :, None] * moves * (emit[:, 1:] * backward[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        live = inside[:, 1:] * weight[:, None]
        toward = (pair * live[:, :, None, None]).sum(axis=(0, 1))
        toward[0, 0] -= (live * (y[:, None] == 0)).sum()
        toward[1, 1] -= (live * (y[:, None] > 0)).sum()
    return np.concatenate([np.einsum("tlw,tl->w", x, pull), toward.ravel()]) / texts


# --- Spark --------------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` and ``quality`` of at most ``SAMPLE`` labelled documents outside the held-out fold, of any
    length, the first by hash of their id. A document with several labels takes the lowest; one without has no part."""
    marked = (
        labels.where(F.col("quality").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg((F.min("quality") > 0).cast("int").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(SAMPLE)
    )
    # At most SAMPLE rows of two numbers.
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(marked), F.col("id") == F.col("label_id")
    ).groupBy("id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select("id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> LineField:
    """Fit on the bounded sample; its features are made in tasks."""

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            made = [drawn_lines(line_features(t.as_py())[0]).tobytes() for t in frame["text"]]
            yield pa.RecordBatch.from_arrays([frame["id"], frame["quality"], pa.array(made, pa.binary())], ["id", "quality", "lines"])

    rows = training_sample(docs, labels, key, text).mapInArrow(features, "id long, quality int, lines binary").collect()
    rows.sort(key=lambda row: row["id"])
    return fit([(np.frombuffer(row["lines"], np.float32).reshape(-1, WIDTH), row["quality"]) for row in rows])


def quality_udf(model: LineField):
    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array([model.quality(text.as_py()) for text in texts], pa.float64())

    return quality


def scored(docs: DataFrame, model: LineField, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, in one pass without a shuffle.

    NULL and empty texts are scored as one empty line; repeated rows are scored
    each; an empty table gives no rows.
    """
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (fold(f"`{key}`", FOLDS) == HELD_OUT).alias("held_out"),
        quality_udf(model)(F.col(f"`{text}`")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: LineField, text: str = "text") -> DataFrame:
    """The documents that the model takes for good, with their own columns."""
    return docs.where(quality_udf(model)(F.col(f"`{text}`")) >= 0.5)
