"""SentencePiece merge-type (BPE) models: exact encoding by backtracking, and decoding.

Merging by score gives a text one encoding. It is found here without a queue
of merges: an Aho-Corasick automaton names the longest piece at every position,
a piece may follow another if merging both strings again yields the two, and
where no piece fits the last one is taken back and its position marked as
failed. Two encodings that fit at every seam are the same, so the first one
that reaches the end is the answer.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from leakframe.llm.tokens import pieces

SPACE = "▁"
CACHED = 200_000  # words whose ids a worker remembers, twice at most
LONGEST_CACHED = 200
ROWS = 256  # id lists decoded at a time
SEAMS = 1_000_000  # pairs of pieces whose compatibility is remembered
#: Texts whose encodings a model must share with this module's reading of it.
PROBES = ("", " ", "  ", "a", " a  b ", "a\n\n b", "\t▁a ▁", "é中\U0001f600", "ﬁ Å", "<s>x</s> <0x41>", "Hello world, this is a longer text.")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """Pieces of a merge-type model with byte fallback, a space put before the text, and no other normalisation."""

    def __init__(self, data: bytes):
        source = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size, self.end = source.get_piece_size(), source.eos_id()
        self.names = [source.id_to_piece(i) for i in range(self.size)]
        special = [source.is_byte(i) or source.is_control(i) or source.is_unknown(i) or source.is_unused(i) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.scores = {p: source.get_score(i) for p, i in self.ids.items()}
        self.bytes = [source.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = source.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model reach over spaces")
        self.raw = [p.replace(SPACE, " ").encode() for p in self.names]
        for i in range(self.size):
            if source.is_control(i):
                self.raw[i] = b""
            elif source.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes):
            if source.is_byte(i):
                self.raw[i] = bytes([b])
        # A piece that merging its own string does not yield never occurs.
        whole = {p for p in self.ids if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), p[0] if len(p) > 1 else None) for p in whole}
        self.edges: dict[str, tuple] = {}
        self.seams: dict[tuple[str, str], bool] = {}
        self.cache = _Cache(self)
        self.table = pa.array(self.raw, pa.binary())
        wrong = [t for t in PROBES if self.encode(t) != source.encode(t, add_eos=True)]
        if wrong:
            raise ValueError(f"this model reads texts in another way: {wrong[:3]}")

    def merged(self, text: str) -> list[str]:
        """The plain rule: merge the neighbours that make the piece of the highest score, the first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """How a piece's left and right edge grow as it is merged: strings, each with the score at which it grows on.

        A merge waits for its parts, so its score counts as no better than theirs.
        """
        known = self.edges.get(piece)
        if known is None:
            parts, when = list(piece), [float("inf")] * len(piece)
            left, right = [(parts[0], -float("inf"))], [(parts[-1], -float("inf"))]
            while len(parts) > 1:
                score, at = max((self.scores.get(parts[i] + parts[i + 1], -float("inf")), -i) for i in range(len(parts) - 1))
                at = -at
                score = min(score, when[at], when[at + 1])
                joined = parts[at] + parts[at + 1]
                if at == 0:
                    left[-1] = (left[-1][0], score)
                    left.append((joined, -float("inf")))
                if at + 2 == len(parts):
                    right[-1] = (right[-1][0], score)
                    right.append((joined, -float("inf")))
                parts[at : at + 2], when[at : at + 2] = [joined], [score]
            known = self.edges[piece] = (left, right)
        return known

    def fits(self, one: str, other: str) -> bool:
        """Whether merging the two strings together leaves the seam between them.

        Both edges are merged up again side by side. The seam closes if what
        meets there makes a piece before either edge grows; of equal scores the
        one further left comes first.
        """
        known = self.seams.get((one, other))
        if known is not None:
            return known
        scores = self.scores
        left, right = self.spines(one)[1], self.spines(other)[0]
        i = j = 0
        known = True
        while True:
            (a, grows_a), (b, grows_b) = left[i], right[j]
            score = scores.get(a + b)
            if score is not None and score > grows_a and score >= grows_b:
                known = False
                break
            if grows_a >= grows_b:
                i += 1
                if i == len(left):
                    break
            else:
                j += 1
        if len(self.seams) >= SEAMS:
            self.seams.clear()
        self.seams[one, other] = known
        return known

    def split(self, word: str) -> list[str]:
        """The pieces of a run of spaces and the characters up to the next space."""
        n = len(word)
        longest: list[str | None] = [None] * n
        for last, piece in self.automaton.iter(word):
            longest[last + 1 - len(piece)] = piece  # longer ones come later
        out: list[str] = []
        at, failed = 0, bytearray(n // 8 + 1)
        piece = longest[0] or word[0]
        while True:
            end = at + len(piece)
            if not (failed[end >> 3] >> (end & 7)) & 1 and (not out or self.fits(out[-1], piece)):
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = longest[at] or word[at]
                continue
            shorter = self.shorter.get(piece)
            if shorter is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
            else:
                piece = shorter

    def ids_of(self, word: str) -> bytes:
        """Ids of a word as 32-bit integers; characters without a piece become their bytes."""
        out = array("i")
        for piece in self.split(word):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.bytes[b] for b in piece.encode())
        return out.tobytes()

    def encoded(self, text: str) -> bytes:
        """Ids of a whole text without an end id."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        # No piece reaches from one word into the next, so words are encoded apart.
        words = text.split(" ") if "  " not in text and text[0] != " " else [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        return b"".join(map(self.cache.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return [*np.frombuffer(self.encoded(text), np.int32).tolist(), self.end]

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        """Ids of all texts with an end id each; null counts as empty."""
        end = np.int32(self.end).tobytes()
        rows = [self.encoded(t) + end if t else end for t in texts.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    def decode_batch(self, ids: pa.ListArray) -> list[str]:
        """Texts of id lists: pieces joined, byte pieces read as UTF-8, the space before the text taken off."""
        ids = ids.cast(pa.list_(pa.int32()))
        flat = self.table.take(pc.list_flatten(ids))
        lengths = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat), b"")
        return [(data[1:] if data[:1] == b" " else data).decode("utf-8", "each_byte") for data in joined.to_pylist()]


class _Cache(dict):
    """Ids of the words seen lately: when full, what was not asked for again since the last time is forgotten."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.model.ids_of(SPACE + word.replace(" ", SPACE))
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


_MODELS: dict[str, Model] = {}


def load(data: bytes) -> Model:
    """The model of a file's bytes, built once in each worker."""
    mark = hashlib.sha256(data).hexdigest()
    if mark not in _MODELS:
        _MODELS.clear()
        _MODELS[mark] = Model(data)
    return _MODELS[mark]


def send(spark: SparkSession, path: str):
    """A model file (half a megabyte) read on the driver and broadcast, so that executors need no copy of it."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, an end id last. Null and empty texts have that id alone."""
    docs = docs.select([c for c in docs.columns if c != ids])
    model = send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model.value)
        for piece in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*piece.columns, m.encode_batch(piece.column(text))], [*piece.schema.names, ids])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType())))


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, and ``text`` replaced by what these ids decode to, in one pass."""
    docs = docs.select([c for c in docs.columns if c != ids])
    model = send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model.value)
        for piece in pieces(batches, text):
            found = m.encode_batch(piece.column(text))
            decoded = pa.array(m.decode_batch(found), pa.string())
            columns = [decoded if c == text else piece.column(c) for c in piece.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, found], [*piece.schema.names, ids])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of every id list; null lists decode to the empty text."""
    docs = docs.select([c for c in docs.columns if c != text])
    model = send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.decode_batch(batch.column(ids)), pa.string())], [*batch.schema.names, text])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(text, StringType()))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row: encoded, decoded from the ids, digested."""
    docs = docs.select(key, text)
    model = send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model.value)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for piece in pieces(batches, text):
            ids = m.encode_batch(piece.column(text))
            written = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(key), pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)),
                    pa.array([digest(row.encode()) for row in written.to_pylist()], pa.string()),
                    pa.array([digest(row.encode()) for row in m.decode_batch(ids)], pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = StructType([docs.schema[key]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.mapInArrow(run, schema)
