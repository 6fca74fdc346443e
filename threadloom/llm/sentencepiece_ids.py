"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an arc for every piece that stands at a place. The
search keeps the best path to each of the last places, as many as the longest
piece has characters, and commits ids as soon as the backpointer paths of all
places that can still go on meet at one boundary. Texts of any length need a
window of bounded size.

Unigram models: the path with the largest sum of scores. Models of merges: an
arc may follow another only if merging would leave the two pieces apart;
exactly one path to each place is left then, that of the merges themselves.
"""

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
# The score of an unknown character lies this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
# Stretches between certain boundaries whose ids a worker remembers.
REMEMBERED = 600_000
REMEMBERED_LENGTH = 48
# Stretches up to this length are one window; the search streams over longer ones.
WINDOW = 256


class PieceModel:
    """Pieces of a model file and the search over them."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.blob = blob
        self.kind = proto.trainer_spec.model_type
        normalizer = proto.normalizer_spec
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is are supported")
        self.prefix = normalizer.add_dummy_prefix
        self.escape = normalizer.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.scores = {}
        self.ids = {}
        self._hidden: set[str] = set()
        for i, piece in enumerate(proto.pieces):
            if piece.type == USER:
                raise ValueError("pieces defined by users are not supported")
            if piece.type == NORMAL:
                self.ids[piece.piece] = i
                self.scores[piece.piece] = piece.score
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        if self.kind == MERGES:
            # Pieces that merging their characters does not give never come out.
            for piece in [p for p in self.scores if len(p) > 1]:
                if self.merged(piece) != [piece]:
                    self._hidden.add(piece)
        # Beginnings of pieces: an arc that is none of them goes no further.
        self.beginnings = {p[:i] for p in self.scores if p not in self._hidden for i in range(1, len(p) + 1)}
        self.lowest = min(self.scores.values(), default=0.0)
        # The id of a piece, -1 for what only begins one.
        self.arcs = {b: self.ids[b] if b in self.scores and b not in self._hidden else -1 for b in self.beginnings}
        self._pairs: dict[int, bool] = {}
        # Ids as 32-bit words, by stretch: those met lately, and those met before.
        self.memory: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self._apart: dict[tuple[str, str], bool] = {}

    def __reduce__(self):
        return PieceModel, (self.blob,)

    # -- arcs --

    @cached_property
    def _cut(self) -> re.Pattern | None:
        """Stretches that no piece crosses the ends of: blanks with the letters after
        them, and characters that stand in no longer piece. None if pieces cross blanks."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            return None
        inner = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        inside = "".join(re.escape(c) for c in sorted(inner)) or re.escape(SPACE)
        return re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours, the first of equals."""
        parts, get, none = list(text), self.scores.get, -np.inf
        joined = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined:
            best = max(joined)
            if best == none:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Merging ``left`` and ``right`` together gives just these two pieces."""
        pair = (left, right)
        known = self._apart.get(pair)
        if known is None:
            if len(self._apart) > 2 * REMEMBERED:
                self._apart.clear()
            known = self._apart[pair] = left + right not in self.scores and self.merged(left + right) == [left, right]
        return known

    # -- search --

    def stream(self, texts) -> Iterator[int]:
        """Ids of a text that comes in parts, each given out once it is certain."""
        search = _Search(self)
        for text in texts:
            for char in text:
                yield from search.read(char)
        yield from search.finish()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for NULL and empty ones."""
        if not text:
            return np.empty(0, np.int32)
        if self.escape:
            text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        if self._cut is None:
            return np.fromiter(self.stream([text]), np.int32)
        stretches = self._cut.findall(text)
        parts = list(map(self.memory.get, stretches))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = self._settled(stretches[i])
        return np.frombuffer(b"".join(parts), np.int32)

    def _settled(self, stretch: str) -> bytes:
        """Ids of a stretch: all paths meet at both of its ends, so they hold in every text."""
        found = self.memory.get(stretch) or self.earlier.get(stretch)
        if found is None:
            if len(stretch) <= WINDOW:
                ids = self._within(stretch)
            else:
                search = _Search(self)
                ids = search.read(stretch) + search.finish()
            found = np.array(ids, np.int32).tobytes()
        if len(stretch) <= REMEMBERED_LENGTH:
            if len(self.memory) >= REMEMBERED:
                self.earlier, self.memory = self.memory, {}
            self.memory[stretch] = found
        return found

    def _within(self, stretch: str) -> list[int]:
        """The search over a stretch that fits in one window: the same arcs from each place on, ids at its end.

        Places are gone through in order, so the paths to a place are all known when arcs leave it,
        and of the arcs that arrive at a place the longest comes first.
        """
        n, get, longest, merges = len(stretch), self.arcs.get, self.longest, self.kind == MERGES
        pairs, count, pieces, scores = self._pairs, len(self.pieces), self.pieces, self.scores
        # By place: the piece that ends there (-1: an unknown character), where it begins, and the score of the path.
        ends, starts, sums = [-2] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        for start in range(n):
            left = ends[start]
            if left == -2 and start:
                continue
            base = sums[start]
            for end in range(start + 1, min(n, start + longest) + 1):
                arc = get(stretch[start:end])
                if arc is None:
                    break
                if arc < 0:
                    continue
                if merges:
                    if ends[end] != -2:
                        continue
                    if left >= 0:
                        fits = pairs.get(left * count + arc)
                        if fits is None:
                            if len(pairs) > 2 * REMEMBERED:
                                pairs.clear()
                            fits = pairs[left * count + arc] = self.apart(pieces[left], pieces[arc])
                        if not fits:
                            continue
                    ends[end], starts[end] = arc, start
                else:
                    score = base + scores[pieces[arc]]
                    if ends[end] == -2 or score > sums[end]:
                        ends[end], starts[end], sums[end] = arc, start, score
            if stretch[start] not in scores:
                # No piece for the character itself: an unknown one may stand here.
                score = base + self.lowest - UNKNOWN_PENALTY
                if ends[start + 1] == -2 or not merges and score > sums[start + 1]:
                    ends[start + 1], starts[start + 1], sums[start + 1] = -1, start, score
        path, at = [], n
        while at > 0:
            path.append((ends[at], stretch[starts[at] : at]))
            at = starts[at]
        ids: list[int] = []
        after_unknown = False
        for arc, char in reversed(path):
            if arc >= 0:
                ids.append(arc)
            elif self.bytes:
                ids += [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
            elif not after_unknown:
                ids.append(self.unknown)
            after_unknown = arc < 0
        return ids

    @cached_property
    def _spelled(self) -> list[bytes]:
        """What each id stands for, in UTF-8."""
        spelled = []
        for piece, kind in zip(self.pieces, self.types, strict=True):
            if kind == BYTE:
                spelled.append(bytes([int(piece[1:-1], 16)]))
            elif kind == UNKNOWN:
                spelled.append(" ⁇ ".encode())
            else:
                spelled.append(b"" if kind == CONTROL else piece.encode())
        return spelled

    def decode(self, ids) -> str:
        """The text of ids: byte pieces as UTF-8, blanks for their marks, without the one put in front."""
        text = b"".join(map(self._spelled.__getitem__, ids)).decode("utf-8", "replace")
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ") if self.escape else text


class _Search:
    """Best paths to the last places of a text. Place 0 is the last boundary that is certain."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""
        # By place: score, place before, piece (None: an unknown character).
        self.best: list[tuple[float, int, str | None] | None] = [(0.0, -1, None)]
        # Arcs under way: places and what has been read since, the longest first.
        self.arcs: list[tuple[int, str]] = []
        self.last: str | None = None
        self.after_unknown = False

    def read(self, part: str) -> list[int]:
        """Go on by some characters; the ids that are certain then."""
        model, ids = self.model, []
        beginnings, scores, hidden, apart = model.beginnings, model.scores, model._hidden, model._apart
        merges, longest = model.kind == MERGES, model.longest
        for char in part:
            places, best, arcs = self.best, None, []
            self.text += char
            if places[-1] is not None:
                self.arcs.append((len(places) - 1, ""))
            for start, read in self.arcs:
                read += char
                if read not in beginnings:
                    continue
                arcs.append((start, read))
                if merges:
                    if best is not None or read not in scores or read in hidden:
                        continue
                    left = places[start][2] if start else self.last
                    fits = left is None or apart.get((left, read))
                    if fits is None:
                        fits = model.apart(left, read)
                    if fits:
                        best = (0.0, start, read)
                elif read in scores:
                    score = scores[read] + places[start][0]
                    if best is None or score > best[0]:
                        best = (score, start, read)
            self.arcs = arcs
            if char not in scores and places[-1] is not None:
                # No piece for the character itself: an unknown one may stand here.
                score = places[-1][0] + model.lowest - UNKNOWN_PENALTY
                if best is None or not merges and score > best[0]:
                    best = (score, len(places) - 1, None)
            places.append(best)
            if len(places) > longest:
                ids += self._commit()
        return ids

    def _commit(self) -> list[int]:
        """Ids up to the last boundary that the paths of all places that can go on share."""
        live = {start for start, _ in self.arcs}
        if self.best[-1] is not None:
            live.add(len(self.best) - 1)
        while len(live) > 1:
            most = max(live)
            live.remove(most)
            live.add(self.best[most][1])
        at = live.pop()
        return self._give(at) if at > 0 else []

    def _give(self, at: int) -> list[int]:
        path, place = [], at
        while place > 0:
            _, before, piece = self.best[place]
            path.append((self.text[before:place], piece))
            place = before
        ids: list[int] = []
        for char, piece in reversed(path):
            if piece is not None:
                ids.append(self.model.ids[piece])
                self.after_unknown = False
            elif self.model.bytes:
                ids += [self.model.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
            elif not self.after_unknown:
                # Unknown characters in a row are one id.
                ids.append(self.model.unknown)
                self.after_unknown = True
        self.last = path[0][1] if path else self.last
        base = self.best[at][0]
        self.text = self.text[at:]
        self.best = [None if b is None else (b[0] - base, b[1] - at, b[2]) for b in self.best[at:]]
        self.arcs = [(start - at, read) for start, read in self.arcs]
        return ids

    def finish(self) -> list[int]:
        return self._give(len(self.text)) if self.text else []


# --- Spark ----------------------------------------------------------------------

_MODELS: dict[bytes, PieceModel] = {}


def _model(blob: bytes) -> PieceModel:
    """One model per worker process, so that what it remembers lasts over tasks."""
    if blob not in _MODELS:
        _MODELS.clear()
        _MODELS[blob] = PieceModel(blob)
    return _MODELS[blob]


def encode_udf(blob: bytes):
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        model = _model(blob)
        return _lists([model.encode(text.as_py()) for text in texts])

    return ids


def decode_udf(blob: bytes):
    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        model = _model(blob)
        flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        return pa.array([model.decode(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string())

    return text


def round_trip_udf(blob: bytes):
    """Ids, and whether decoding them gives the text back, in one go."""

    @F.arrow_udf("ids array<int>, same boolean")
    def both(texts: pa.Array) -> pa.Array:
        model = _model(blob)
        values = texts.to_pylist()
        found = [model.encode(value) for value in values]
        same = [model.decode(ids.tolist()) == (value or "") for ids, value in zip(found, values, strict=True)]
        return pa.StructArray.from_arrays([_lists(found), pa.array(same, pa.bool_())], ["ids", "same"])

    return both


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(f) for f in found], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def round_trip(docs: DataFrame, blob: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_ids and whether decoding gives the text back, of every row.

    NULL and empty texts have no ids and decode to an empty text; repeated rows are
    encoded each; an empty table gives no rows. A text that holds the mark for
    blanks itself decodes to blanks, as the format has it.
    """
    return (
        docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), round_trip_udf(blob)(F.col(f"`{text}`")).alias("found"))
        .select("doc_id", "found.ids", F.size("found.ids").cast("long").alias("n_ids"), F.col("found.same").alias("round_trip"))
    )
