"""Log-bilinear language model, and the unigram model it is held against.

Counts of words cover all training documents. The neural model speaks of a
small set of symbols: the most frequent words, classes of the other words by
their last two bytes, and the end of a text. It predicts a symbol from the two before, and the
word inside a class follows from the counts, so every probability is normalised. Its
training data are the counts of symbol triples over all training documents, at
most SYMBOLS ** 3 rows, and noise-contrastive estimation runs on them in numpy.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import NUMBER_BATCH, batches, fold
from threadloom.operators.joins import salted_join
from threadloom.sources.tables import materialize, materialize_counted

FOLDS, HELD_OUT = 5, 1
# Symbols of the neural model, and how many of them are words.
SYMBOLS, WORDS = 128, 64
# Words whose counts every task gets, and the longest among them in bytes; all
# other words are looked up by a join.
HEAD, HEAD_BYTES = 150_000, 64
END = b""
_FLUSH = 200_000
_STEP = 8


def tokens_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z alone) and one end; NULL counts as empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


# --- the neural model -----------------------------------------------------------


class LogBilinear:
    """score(w | u, v) = (first * r_u + second * r_v) . q_w + b_w over symbols."""

    def __init__(self, symbols: int, size: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.3, (symbols, size))
        self.q = rng.normal(0, 0.1, (symbols, size))
        self.c = np.ones((2, size)) * np.array([[0.5], [1.0]])
        self.b = np.zeros(symbols)

    def log_probabilities(self) -> np.ndarray:
        """log10 P(w | u, v) as [u, v, w], by batched matrix products and a softmax over all symbols."""
        n = len(self.b)
        context = (self.r * self.c[0])[:, None, :] + (self.r * self.c[1])[None, :, :]
        scores = context.reshape(n * n, -1) @ self.q.T + self.b
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return (scores / np.log(10)).reshape(n, n, n)

    def fit(self, codes: np.ndarray, counts: np.ndarray, steps: int = 1_500, batch: int = 2_048, noise: int = 64, seed: int = 0):
        """Noise-contrastive estimation on triples drawn by their counts, with noise from the unigram counts."""
        n = len(self.b)
        rng = np.random.default_rng(seed)
        total = counts.sum()
        if not total:
            return self
        ends = np.cumsum(counts / total)
        unigram = np.bincount(codes % n, counts, n)
        unigram = (unigram + 0.5) / (unigram + 0.5).sum()
        self.b = np.log(unigram)
        log_noise = np.log(noise * unigram)
        names = ("r", "q", "c", "b")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        eye = np.eye(n)
        for step in range(1, steps + 1):
            drawn = codes[np.minimum(np.searchsorted(ends, rng.random(batch)), len(codes) - 1)]
            u, v, w = drawn // (n * n), drawn // n % n, drawn % n
            other = rng.choice(n, noise, p=unigram)
            context = self.r[u] * self.c[0] + self.r[v] * self.c[1]
            good = (context * self.q[w]).sum(axis=1) + self.b[w] - log_noise[w]
            bad = context @ self.q[other].T + self.b[other] - log_noise[other]
            pull = (_sigmoid(good) - 1.0) / batch
            push = _sigmoid(bad) / batch
            of_context = pull[:, None] * self.q[w] + push @ self.q[other]
            one_w, one_o = eye[w], eye[other]
            gradient = {
                "q": one_w.T @ (pull[:, None] * context) + one_o.T @ (push.T @ context),
                "b": np.bincount(w, pull, n) + one_o.T @ push.sum(axis=0),
                "r": eye[u].T @ (of_context * self.c[0]) + eye[v].T @ (of_context * self.c[1]),
                "c": np.stack([(of_context * self.r[u]).sum(axis=0), (of_context * self.r[v]).sum(axis=0)]),
            }
            rate = 0.02 * (1.0 - 0.9 * step / steps)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * gradient[k]
                second[k] = 0.999 * second[k] + 0.001 * gradient[k] ** 2
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(self, k, getattr(self, k) - rate * move)
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


# --- vocabulary -----------------------------------------------------------------


@dataclass
class Vocabulary:
    """Head words by place, with their counts and symbols; classes of all other words."""

    places: dict[bytes, int]
    counts: np.ndarray
    symbols: np.ndarray
    # log10 of (N + 0.5 (V + 1)) of a class; zero for the symbols that are one word.
    weight: np.ndarray
    classes: dict[bytes, int]
    end: int
    train_tokens: int
    distinct: int

    def class_of(self, word: bytes) -> int:
        return self.classes.get(word[-2:], WORDS)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the head (-1: not there), symbols, and the spots of the -1."""
        place = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        symbol = self.symbols[place]
        spots = np.flatnonzero(place < 0)
        if len(spots):
            symbol[spots] = [self.class_of(words[i]) for i in spots.tolist()]
        return place, symbol, spots


def word_counts(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``word`` and ``n`` over all texts of ``docs``, the number of tokens and of words.
    A task adds up its own words before anything is shuffled."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for frame in frames:
            for text in frame["text"]:
                seen.update(tokens_of(text.as_py()))
            if len(seen) > _FLUSH:
                yield batch()
                seen = Counter()
        if seen:
            yield batch()

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts, found = materialize_counted(counted, "word-counts", tokens=F.sum("n"), distinct=F.count(F.lit(1)))
    return counts, found["tokens"], found["distinct"]


def vocabulary(counts: DataFrame, tokens: int, distinct: int) -> Vocabulary:
    """The head by a cut in the counts, which a histogram of at most a few hundred steps gives; classes by
    suffix, of which there are at most 65,536 and some."""
    short = counts.where((F.octet_length("word") <= HEAD_BYTES) & (F.octet_length("word") > 0))
    step = F.floor(F.log2("n") * _STEP).cast("int")
    cut, kept = None, 0
    for row in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        kept += row["count"]
        if kept > HEAD:
            break
        cut = row["step"]
    head = []
    if cut is not None:
        head = [(bytes(r["word"]), r["n"]) for r in short.where(step >= cut).collect()]
    head.sort(key=lambda row: (-row[1], row[0]))
    chosen = {word for word, _ in head[:WORDS]}
    suffix = F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")
    groups = {
        bytes(r["suffix"]): [r["tokens"], r["words"]]
        for r in counts.where(F.octet_length("word") > 0)
        .groupBy(suffix.alias("suffix"))
        .agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"))
        .collect()
    }
    for word, n in head[:WORDS]:
        groups[word[-2:]][0] -= n
        groups[word[-2:]][1] -= 1
    # Symbols: words, the class of all other suffixes, classes, the end.
    ranked = sorted(groups, key=lambda s: (-groups[s][0], s))[: SYMBOLS - WORDS - 2]
    classes = {s: WORDS + 1 + i for i, s in enumerate(ranked)}
    mass = np.zeros((SYMBOLS, 2))
    for s, (n, words) in groups.items():
        mass[classes.get(s, WORDS)] += (n, words)
    weight = np.zeros(SYMBOLS)
    weight[WORDS : SYMBOLS - 1] = np.log10(mass[WORDS:-1, 0] + 0.5 * (mass[WORDS:-1, 1] + 1))
    end = SYMBOLS - 1
    ends = [r["n"] for r in counts.where(F.octet_length("word") == 0).collect()]
    places = {word: i for i, (word, _) in enumerate(head)}
    places[END] = len(head)
    order = {word: i for i, (word, _) in enumerate(head[:WORDS])}
    symbols = [order[w] if w in chosen else classes.get(w[-2:], WORDS) for w, _ in head]
    # The last entry stands for words that are not in the head.
    return Vocabulary(
        places,
        np.array([n for _, n in head] + [sum(ends), 0], np.float64),
        np.array([*symbols, end, WORDS], np.int64),
        weight,
        classes,
        end,
        tokens,
        distinct,
    )


def triples(vocab: Vocabulary, texts: list[list[bytes]]):
    """Codes of (two symbols before, symbol) of each token of all texts, with places and spots."""
    flat = [word for words in texts for word in words]
    place, symbol, spots = vocab.encode(flat)
    before = np.r_[vocab.end, symbol[:-1]]
    starts = np.cumsum([0] + [len(words) for words in texts[:-1]])
    # A text begins after two ends; the first of a text sees the end of the one before.
    earlier = np.r_[vocab.end, before[:-1]]
    earlier[starts] = vocab.end
    codes = (earlier * SYMBOLS + before) * SYMBOLS + symbol
    return flat, starts, place, spots, symbol, codes


# --- Spark ----------------------------------------------------------------------


def train(spark: SparkSession, docs: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """Fit on the triple counts of all texts of ``docs``."""
    shared = spark.sparkContext.broadcast(vocab)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for frame in frames:
            texts = [tokens_of(text.as_py()) for text in frame["text"]]
            if texts:
                codes = triples(shared.value, texts)[-1]
                found, n = np.unique(codes, return_counts=True)
                total[found] += n
        codes = np.flatnonzero(total)
        for at in range(0, len(codes), NUMBER_BATCH):
            part = codes[at : at + NUMBER_BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["code", "n"])

    table = docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes = table["code"].to_numpy().astype(np.int64)
    order = np.argsort(codes)
    return LogBilinear(SYMBOLS).fit(codes[order], table["n"].to_numpy().astype(np.float64)[order])


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    NULL and empty texts are one end. Repeated rows count and are scored each.
    Without training documents there are no counts, and every symbol is as
    likely as its bias says. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (fold(f"`{key}`", FOLDS) == HELD_OUT).alias("held_out"),
        F.col(f"`{text}`").alias("text"),
    )
    learning = rows.where(~F.col("held_out"))
    counts, tokens, distinct = word_counts(learning)
    vocab = vocabulary(counts, tokens, distinct)
    model = train(spark, learning, vocab)
    shared = spark.sparkContext.broadcast((vocab, model))
    base_weight = float(np.log10(tokens + 0.5 * (distinct + 1)))
    schema = (
        "place long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
        "word binary, n long, weight double"
    )

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        chances = model.log_probabilities().ravel()
        logs = np.log10(vocab.counts + 0.5)
        for frame in frames:
            if not frame.num_rows:
                continue
            texts = [tokens_of(text.as_py()) for text in frame["text"]]
            flat, starts, place, spots, symbol, codes = triples(vocab, texts)
            inside = place >= 0
            base = np.where(inside, logs[place] - base_weight, 0.0)
            # Inside a class the counts decide; a symbol that is a word is certain.
            within = np.where(inside & (symbol >= WORDS) & (symbol != vocab.end), logs[place] - vocab.weight[symbol], 0.0)
            known = inside & (vocab.counts[place] > 0)
            ids = frame["place"].to_numpy()
            owner = np.searchsorted(starts, spots, side="right") - 1
            rest = Counter(zip(owner.tolist(), (flat[i] for i in spots.tolist()), strict=True))
            m, k = len(texts), len(rest)
            keys = list(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[ids, ids[[o for o, _ in keys]]] if k else ids, pa.int64()),
                    pa.concat_arrays([frame["doc_id"], pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([frame["held_out"], pa.nulls(k, pa.bool_())]),
                    pa.array([len(words) for words in texts] + [None] * k, pa.int64()),
                    pa.concat_arrays([pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([pa.array(np.add.reduceat(base, starts)), pa.nulls(k, pa.float64())]),
                    pa.concat_arrays([pa.array(np.add.reduceat(chances[codes] + within, starts)), pa.nulls(k, pa.float64())]),
                    pa.array([None] * m + [word for _, word in keys], pa.binary()),
                    pa.array([None] * m + list(rest.values()), pa.int64()),
                    pa.array([None] * m + [float(vocab.weight[vocab.class_of(word)]) for _, word in keys], pa.float64()),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    numbered = rows.withColumn("place", F.monotonically_increasing_id())
    parts = materialize(numbered.mapInArrow(score, schema), "scores")
    whole = parts.where("word IS NULL").drop("word", "n", "weight")
    rest = parts.where("word IS NOT NULL").select(F.col("place").alias("of"), "word", "n", "weight")
    known = counts.select(F.col("word").alias("known_word"), F.col("n").alias("c"))
    found = salted_join(rest, known, "word", "known_word", "left", spread=F.col("of"))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = found.groupBy("of").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (log - base_weight)).alias("more_base"),
        F.sum(F.col("n") * (log - F.col("weight"))).alias("more_score"),
    )
    return whole.join(sums, F.col("place") == F.col("of"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
