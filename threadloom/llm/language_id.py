"""Language of a text from a byte convolutional network.

Bytes in lower case are embedded, filters of several widths run over them, the
largest answer of each filter in a window of fixed length goes through a softmax.
A text is cut into such windows, all of them; their probabilities are averaged by the letters in them.
Trained in numpy on labelled windows.

Filters of even width over bytes are sums over byte pairs, so a trained network is
applied by looking pairs up in tables; results are those of the convolution.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import fold

FOLDS, HELD_OUT = 4, 2
WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 16
SIZE = 8
# Labelled documents of a language that the network learns from, at most, and of all languages
# together, and windows drawn from each: bounds of what reaches the driver.
SAMPLE, MOST, WINDOWS = 1_500, 12_000, 2
DRAWS = 1 << 40
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BATCH = 64
_IS_LETTER = np.zeros(256, np.float32)
_IS_LETTER[np.r_[65:91, 97:123, 0xC3:0xF5]] = 1.0


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def windows_of(text: str | None, window: int = WINDOW) -> np.ndarray:
    """The bytes of a whole text as rows of ``window``, the last one padded with zeros."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    rows = np.zeros(-(-len(raw) // window) * window, np.uint8)
    rows[: len(raw)] = np.frombuffer(raw, np.uint8)
    return rows.reshape(-1, window)


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, SIZE)).astype(np.float32)
        self.embed[0] = 0.0
        self.filters = [rng.normal(0, (w * SIZE) ** -0.5, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)
        self._tables = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def _step(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over a batch of windows."""
        n, length = rows.shape
        x = self.embed[rows]
        tops, where, patches = [], [], []
        for w, filters, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            patch = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), w * SIZE, axis=1)[:, ::SIZE]
            answer = patch.reshape(-1, w * SIZE) @ filters + bias
            answer = answer.reshape(n, length - w + 1, FILTERS)
            best = answer.argmax(axis=1)
            where.append(best)
            patches.append(patch)
            tops.append(np.maximum(np.take_along_axis(answer, best[:, None], axis=1)[:, 0], 0.0))
        hidden = np.concatenate(tops, axis=1)
        chance = _softmax(hidden @ self.out + self.shift)
        chance[np.arange(n), labels] -= 1.0
        chance /= n
        back = (chance @ self.out.T) * (hidden > 0)
        of_embed = np.zeros_like(self.embed)
        of_filters, of_bias = [], []
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = patches[i][np.arange(n)[:, None], where[i]]
            of_filters.append(np.einsum("nfk,nf->kf", chosen, part))
            of_bias.append(part.sum(axis=0))
            to = np.einsum("nf,kf->nfk", part, self.filters[i]).reshape(-1, SIZE)
            spots = where[i][:, :, None] + np.arange(w)
            np.add.at(of_embed, rows[np.arange(n)[:, None, None], spots].ravel(), to)
        of_embed[0] = 0.0
        return [of_embed, *of_filters, *of_bias, hidden.T @ chance, chance.sum(axis=0)]

    def fit(self, rows: np.ndarray, labels: np.ndarray, rounds: int = 6, batch: int = 128, seed: int = 0):
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        state = [self.embed, *self.filters, *self.bias, self.out, self.shift]
        first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
        step = 0
        for turn in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                step += 1
                part = order[at : at + batch]
                rate = 0.01 / (1 + turn)
                for s, a, b, g in zip(state, first, second, self._step(rows[part], labels[part]), strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    s -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self._tables = None
        return self

    def _pairs(self) -> list[list[np.ndarray]]:
        """For each width and place, the share of every byte pair in the filters' sums."""
        if self._tables is None:
            self._tables = [
                [
                    (
                        (self.embed @ filters[2 * j * SIZE : (2 * j + 1) * SIZE])[:, None, :]
                        + (self.embed @ filters[(2 * j + 1) * SIZE : (2 * j + 2) * SIZE])[None, :, :]
                    ).reshape(65_536, FILTERS)
                    for j in range(w // 2)
                ]
                for w, filters in zip(WIDTHS, self.filters, strict=True)
            ]
        return self._tables

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Softmax over languages for each window, in batches."""
        found = np.zeros((len(rows), len(self.languages)), np.float32)
        for at in range(0, len(rows), _BATCH):
            # Places first, windows second: filters slide and pool over whole slices.
            part = np.ascontiguousarray(rows[at : at + _BATCH].T).astype(np.intp)
            pairs = part[:-1] * 256 + part[1:]
            tops = []
            for w, tables, bias in zip(WIDTHS, self._pairs(), self.bias, strict=True):
                length = WINDOW - w + 1
                total = np.take(tables[0], pairs[:length], axis=0)
                for j in range(1, w // 2):
                    total += np.take(tables[j], pairs[2 * j : 2 * j + length], axis=0)
                tops.append(np.maximum(total.max(axis=0) + bias, 0.0))
            found[at : at + _BATCH] = _softmax(np.concatenate(tops, axis=1) @ self.out + self.shift)
        return found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; ``und`` and 0 without a letter."""
        parts = [windows_of(text) if has_letter(text) else windows_of("") for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        if not len(owner) or not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        rows = np.concatenate(parts)
        weight = _IS_LETTER[rows].sum(axis=1) + 1e-3
        chance = self.probabilities(rows) * weight[:, None]
        total = np.stack([np.bincount(owner, c, len(texts)) for c in chance.T], axis=1)
        weight = np.bincount(owner, weight, len(texts))
        out = []
        for i in range(len(texts)):
            if not len(parts[i]):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(total[i].argmax())
            out.append((self.languages[best], min(1.0, float(total[i, best] / weight[i]))))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- Spark ----------------------------------------------------------------------


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet:
    """Fit on windows of a bounded sample: of each language the first documents by hash of their
    id, outside the held-out fold, as many as ``SAMPLE`` and an even share of ``MOST`` allow, and one
    at least. Languages with fewer come in whole; every language is learned, and all weigh the same. Of each document
    ``WINDOWS`` windows are taken, from any part of it. Rows without text, letters or language have
    no part; without any, the network knows no language."""
    letters = F.col(f"`{text}`").rlike(r"\p{L}")
    usable = docs.where(
        F.col(f"`{lang}`").isNotNull() & letters & F.col(f"`{text}`").isNotNull() & (fold(f"`{key}`", FOLDS) != HELD_OUT)
    ).select(
        F.pmod(F.xxhash64(F.col(f"`{key}`").cast("long")), F.lit(DRAWS)).alias("draw"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
    )
    # One row a language, as many as the network has outputs.
    sizes = usable.groupBy("lang").agg(F.count("*").alias("rows"), F.min("draw").alias("first")).collect()
    if not sizes:
        return ByteNet([])
    most = max(1, min(SAMPLE, MOST // len(sizes)))
    # Cut by draw, with room to spare and never below the first, so that few texts are ranked.
    bounds = [(r["lang"], max(r["first"], int(min(1.0, (2 * most + 20) / r["rows"]) * DRAWS))) for r in sizes]
    bound = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    near = usable.join(F.broadcast(bound), "lang").where(F.col("draw") <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= most)

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            made, langs = [], []
            for value, name in zip(frame["text"], frame["lang"], strict=True):
                if has_letter(value.as_py()):
                    rows = windows_of(value.as_py())
                    rng = np.random.default_rng(zlib.crc32(rows.tobytes()))
                    spots = rng.permutation(len(rows))[:WINDOWS]
                    made += [rows[i].tobytes() for i in spots]
                    langs += [name.as_py()] * len(spots)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(langs, pa.string())], ["row", "lang"])

    # At most WINDOWS rows for each of MOST documents, or of one a language.
    rows = sample.select("text", "lang").mapInArrow(cut, "row binary, lang string").collect()
    if not rows:
        return ByteNet([])
    rows.sort()
    languages, labels = np.unique([r["lang"] for r in rows], return_inverse=True)
    table = np.stack([np.frombuffer(bytes(r["row"]), np.uint8) for r in rows])
    # Windows of rarer languages come up again, as often as those of the largest.
    counts = np.bincount(labels)
    spots = [np.resize(np.flatnonzero(labels == i), counts.max()) for i in range(len(counts))]
    order = np.concatenate(spots)
    return ByteNet(languages.tolist()).fit(table[order], labels[order])


def language_udf(model: ByteNet):
    @F.arrow_udf("lang string, score double")
    def language(texts: pa.Array) -> pa.Array:
        found = model.predict(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"]
        )

    return language


def predicted(docs: DataFrame, model: ByteNet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, in one pass without a shuffle.

    NULL, empty and letterless texts are ``und`` with score 0; repeated rows get the
    same answer; an empty table gives no rows.
    """
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (fold(f"`{key}`", FOLDS) == HELD_OUT).alias("held_out"),
        language_udf(model)(F.col(f"`{text}`")).alias("found"),
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
