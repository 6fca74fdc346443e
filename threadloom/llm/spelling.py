"""Spelling variants: which words of a corpus differ by one letter, and which of them is the form.

Words meet in groups. Of two words that differ by one insertion, deletion or
replacement, with ``size`` letters in the shorter, the first or the last
``size // 2`` letters are the same, so each word goes to the groups of its
beginning and of its end, once for its own size and once for that of a word
shorter by one. A group with too many words is cut in the same way again,
by half of the letters in the middle that are not known to be the same yet.
Where one letter is left, a group has at most the square of the alphabet, so no
group stays large, and no word is left out.

Inside a group a bit-sliced position index compares all words at once: for each
position and letter there is a bitset over the words that have it there. A word
is read letter by letter, and two sets move along for 64 words in each step:
those equal so far, and those with one error so far, the latter once for each
shift of position that the error leaves behind. Many words are read together.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import NUMBER_BATCH, batches
from threadloom.operators.joins import salted_join, sized_join
from threadloom.sources.tables import materialize, materialize_counted

LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form has so many times the occurrences of its variant.
RATIO = 10
# One in so many runs loses a letter, by crc32 of document and run.
SLIP = 31
# Words of a group, and its letters, beyond which it is cut further.
GROUP_WORDS = 16_384
GROUP_LETTERS = 4_000_000
# Words that a task looks through together, and words read at a time.
_BLOCK = 4_096
_READ = 256
_PAIRS = 50_000
# Keyed words of a task.
TASK_WORDS = 500_000

# Words that a task counts before it hands counts on.
TABLE_WORDS = 200_000
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


# --- words --------------------------------------------------------------------


def words_in(text: str, key: str) -> list[str]:
    """The words of one text. Shorter runs cannot become words and are passed over.

    A run loses one letter where crc32 of ``<key>:<run>`` says so.
    """
    start, words = zlib.crc32(key.encode() + b":"), []
    for run in _RUN.findall(text):
        run = run.lower() if run.isascii() else run.translate(_LOWER)
        mark = zlib.crc32(run.encode(), start)
        if mark % SLIP == 0:
            at = mark % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        words.append(run)
    return words


def _counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, put together in a table of bounded size."""
    counts: Counter[str] = Counter()
    for frame in frames:
        for key, text in zip(frame["key"], frame["text"], strict=True):
            counts.update(words_in(text.as_py(), key.as_py()))
            if len(counts) >= TABLE_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                counts.clear()
    if counts:
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences.

    Counts combine in the tasks, so a very frequent word costs a row or a few of each.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text")
    ).where(F.col("text").isNotNull())
    return (
        texts.mapInArrow(_counted, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


# --- the index ----------------------------------------------------------------


class PositionIndex:
    """Bitsets over words: by (position, letter), and by length."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        alphabet, self.codes = np.unique(letters, return_inverse=True)
        self.words = -(-len(words) // 64)
        self.bits: list[np.ndarray] = []
        for at in range(int(self.lengths.max(initial=0))):
            holders = np.flatnonzero(self.lengths > at)
            mask = np.zeros((len(alphabet), 64 * self.words), bool)
            mask[self.codes[self.starts[holders] + at], holders] = True
            self.bits.append(np.packbits(mask, axis=1, bitorder="little").view(np.uint64))

    def of_length(self, length: int) -> np.ndarray:
        mask = np.zeros(64 * self.words, bool)
        mask[: len(self.lengths)] = self.lengths == length
        return np.packbits(mask, bitorder="little").view(np.uint64)

    def _having(self, at: int, letters: np.ndarray, span: slice) -> np.ndarray | int:
        """For each letter, the words that have it at that position."""
        return self.bits[at][letters, span] if 0 <= at < len(self.bits) else np.uint64(0)

    def near(self, rows: np.ndarray, low: int, high: int, deleted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, word) one error apart; ``rows`` are places of words of one
        length, and the words looked at are those from ``low`` to below ``high``.

        ``deleted`` also finds words shorter by one letter.
        """
        length = int(self.lengths[rows[0]])
        span = slice(low // 64, -(-high // 64))
        shape = (len(rows), span.stop - span.start)
        equal = np.full(shape, ~np.uint64(0))
        replaced, inserted, missing = (np.zeros(shape, np.uint64) for _ in range(3))
        codes = self.codes[self.starts[rows][:, None] + np.arange(length)]
        for at in range(length):
            letters = codes[:, at]
            here = self._having(at, letters, span)
            inserted |= equal
            inserted &= self._having(at + 1, letters, span)
            if deleted:
                missing &= self._having(at - 1, letters, span)
                missing |= equal
            replaced &= here
            replaced |= equal & ~here
            equal &= here
            # Given up once no word is left in any of the sets.
            if at % 4 == 3 and not any(s.any() for s in (equal, replaced, inserted, missing)):
                break
        inserted |= equal
        found = (replaced & self.of_length(length)[span]) | (inserted & self.of_length(length + 1)[span])
        if deleted:
            found |= missing & self.of_length(length - 1)[span]
        row, part = np.nonzero(found)
        bits = np.unpackbits(found[row, part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        word = (span.start + part[which]) * 64 + bit
        inside = (word >= low) & (word < high)
        return rows[row[which[inside]]], word[inside]


# --- groups -------------------------------------------------------------------


def _middle(size: Column, path: str) -> tuple[Column, Column, Column]:
    """Letters known to be the same at the beginning and at the end, and half of the rest, for a way of cuts."""
    first = last = F.lit(0)
    for cut in path:
        half = F.floor((size - first - last) / 2).cast("int")
        first, last = (first + half, last) if cut == "b" else (first, last + half)
    return first, last, F.floor((size - first - last) / 2).cast("int")


def bounds(size: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """The same for one size: beginning, end, and the spans that differ, because words equal there met elsewhere."""
    first = last = 0
    apart = []
    for cut in path:
        half = (size - first - last) // 2
        if cut == "b":
            first += half
        else:
            apart.append((first, first + half))
            last += half
    return first, last, apart


def _keyed(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (word, n, size) in the groups of ``path``: a hash of size, way and the letters that are the same.

    Words of different groups with one hash meet for nothing; letters are compared again.
    """
    first, last, _ = _middle(F.col("size"), path)
    beginning = F.substring("word", F.lit(1), first)
    end = F.substring("word", F.length("word") - last + 1, last)
    return rows.select(
        F.xxhash64("size", F.lit(path), beginning, end).alias("group"),
        F.lit(path).alias("path"), "size", "word", "n",
    )


def grouped(words: DataFrame, group_words: int = GROUP_WORDS, group_letters: int = GROUP_LETTERS) -> tuple[list[DataFrame], int]:
    """Tables of keyed words whose groups are bounded, and the number of their rows.

    Groups over a bound are cut once more, by beginning and by end, until the
    middle has one letter.
    """
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where(
        F.col("size") >= LEAST_LENGTH
    )
    waiting = {"b": sized, "e": sized}
    tables, total = [], 0
    while waiting:
        again: dict[str, DataFrame] = {}
        for path, rows in waiting.items():
            keyed, found = materialize_counted(_keyed(rows, path), "keyed", rows=F.count(F.lit(1)))
            if not found["rows"]:
                continue
            _, _, half = _middle(F.col("size"), path)
            hot, many = materialize_counted(
                keyed.where(half > 0)
                .groupBy("group")
                .agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("letters"))
                .where((F.col("words") > group_words) | (F.col("letters") > group_letters))
                .select(F.col("group").alias("_hot")),
                "hot-groups",
                rows=F.count(F.lit(1)),
            )
            if many["rows"]:
                spread = F.xxhash64("word", "size")
                marked = materialize(sized_join(keyed, hot, "group", "_hot", "left", spread=spread), "keyed")
                again[path + "b"] = again[path + "e"] = marked.where("_hot is not null").select("word", "n", "size")
                keyed = marked.where("_hot is null").drop("_hot")
            tables.append(keyed)
            total += found["rows"]
        waiting = again
    return tables, total


def _pairs_of(words: list[str], groups: list[tuple]) -> Iterator[list[tuple[int, int]]]:
    """Places of near words in a block of whole groups; each pair once, in the group that owns it."""
    index = PositionIndex(words)
    edges = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]] + [len(groups)]
    of_row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    at = 0
    while at < len(edges) - 1:
        # Groups of one size and way whose words are read together.
        _, path, size = groups[edges[at]]
        upto = at + 1
        while upto < len(edges) - 1 and groups[edges[upto]][1:] == (path, size) and edges[upto] - edges[at] < _READ:
            upto += 1
        low, high = edges[at], edges[upto]
        first, last, apart = bounds(size, path)
        own = np.arange(low, high)
        own = own[index.lengths[low:high] == size]
        for start in range(0, len(own), _READ):
            left, right = index.near(own[start : start + _READ], low, high, deleted=False)
            same = of_row[left] == of_row[right]
            kept = []
            for i, j in zip(left[same].tolist(), right[same].tolist(), strict=True):
                a, b = words[i], words[j]
                if a[:first] == b[:first] and a[len(a) - last :] == b[len(b) - last :] and all(a[x:y] != b[x:y] for x, y in apart):
                    kept.append((i, j))
            yield kept
        at = upto


def _near_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (word, near, near_n), both ways but for words of one length, which find each other."""

    def batch(pairs: list[tuple[int, int]], words: list[str], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": [words[i] for i, _ in pairs], "near": [words[j] for _, j in pairs], "near_n": [counts[j] for _, j in pairs]}
        )

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        words, counts, groups = [r[3] for r in rows], [r[4] for r in rows], [r[:3] for r in rows]
        pairs = []
        for found_here in _pairs_of(words, groups):
            pairs += found_here
            pairs += [(j, i) for i, j in found_here if len(words[i]) != len(words[j])]
            if len(pairs) >= _PAIRS:
                yield batch(pairs, words, counts)
                pairs = []
        if pairs:
            yield batch(pairs, words, counts)

    block: list[tuple] = []
    group: list[tuple] = []
    for frame in frames:
        for row in zip(*(column.to_pylist() for column in frame.columns), strict=True):
            if group and row[:3] != group[0][:3]:
                # A word alone in its group has nobody to meet.
                if len(group) > 1:
                    block += group
                group = []
                if len(block) >= _BLOCK:
                    yield from found(block)
                    block = []
            group.append(row)
    if len(group) > 1:
        block += group
    if block:
        yield from found(block)


def near_words(words: DataFrame, group_words: int | None = None, group_letters: int | None = None) -> DataFrame:
    """All ordered pairs (word, near, near_n) of words that differ by one letter.

    ``words`` is a stored table with unique ``word`` and ``n``.
    """
    tables, rows = grouped(words, group_words or GROUP_WORDS, group_letters or GROUP_LETTERS)
    if not tables:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    slots = words.sparkSession.sparkContext.defaultParallelism
    keyed = tables[0]
    for table in tables[1:]:
        keyed = keyed.unionByName(table)
    parts = max(1, -(-rows // TASK_WORDS), min(2 * slots, rows // _BLOCK))
    dealt = keyed.repartition(parts, "group").sortWithinPartitions("path", "size", "group", "word")
    return dealt.select("group", "path", "size", "word", "n").mapInArrow(_near_words, "word string, near string, near_n long")


# --- forms --------------------------------------------------------------------


def last_forms(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms, for words that have a form.

    A form is ten times as frequent, so chains are short; pointers double each round.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        state, found = materialize_counted(
            salted_join(state, ahead, "root", "at", "left", spread=F.xxhash64("word")).select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "forms",
            moved=F.count_if("moved"),
        )
        state = state.drop("moved")
        if not found["moved"]:
            return state


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word.

    The form is the most frequent near word, the smallest among equals, if it is ``ratio`` times
    as frequent as the word; the root is where following forms ends. NULL and
    empty texts have no words; a NULL id counts as empty text; repeated rows count each; an empty
    table gives no rows. Very long words take a bit of memory a letter, no more.
    """
    words = materialize(word_counts(docs, key, text), "words")
    near = (
        near_words(words)
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"),
        )
        .withColumnRenamed("word", "of")
    )
    best_n = -F.col("best.less")
    has_form = best_n >= ratio * F.col("n")
    with batches(docs.sparkSession, NUMBER_BATCH):
        found = materialize(
            words.join(near, F.col("word") == F.col("of"), "left").select(
                "word", "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(has_form, F.col("best.near")).alias("form"),
                F.when(has_form, best_n).alias("form_n"),
            ),
            "near-words",
        )
    roots = last_forms(found.where("form is not null")).withColumnRenamed("word", "of")
    return found.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
