"""BPE encoding and decoding with the contiguous rank array.

A word short enough to stay in a few cache lines is held as two parallel lists: the parts
between boundaries, and the rank of merging each part with its right neighbour. The list
of ranks is scanned for the minimum, that boundary is deleted, and the two neighbouring
ranks are refreshed, until no rank is left. Beyond ``LONG`` bytes a heap takes the place
of the scan, with the same merges, so that a very long word costs n log n.

Texts are cut into words (white space as GPT-like byte-level patterns see it); a worker
keeps the ids of the words it has seen in a bounded cache.

Null and empty texts have no tokens and decode to the empty text. Repeated rows are coded
each for itself. Special strings in a text become their ids.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import carried, kept, prepare, slices, strings

LONG = 256
CACHED = 200_000
PIECES = 50_000
INFINITE = 1 << 60
ID_BITS = 32
ID_MASK = (1 << ID_BITS) - 1
# white space for the pattern: Python's \s without the four separators it adds
_BLANK, _SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CHUNK = re.compile(rf" ?{_SOLID}+|{_BLANK}+(?!{_SOLID})|{_BLANK}+")


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for (printable bytes stand for themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file; bounded by the file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.byte_ids = [ids.get(c, 0) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: Pair -> rank and merged id in one number, which sorts by rank.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = rank << ID_BITS | ids[a + b]
        self.pattern = pattern


def merge_short(parts: list[int], merges: dict) -> list[int]:
    """Scan for the least rank, delete its boundary, refresh the ranks beside it."""
    get = merges.get
    ranks = [get(p, INFINITE) for p in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == INFINITE:
            break
        i = ranks.index(low)
        parts[i] = now = low & ID_MASK
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get((parts[i - 1], now), INFINITE)
        if i < len(ranks):
            ranks[i] = get((now, parts[i + 1]), INFINITE)
    return parts


def merge_long(parts: list[int], merges: dict) -> list[int]:
    """The same merges with a heap of (rank, position) over a linked list."""
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(m, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (m := merges.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if parts[i] != pair[0] or j >= n or parts[j] != pair[1]:
            continue
        parts[i], parts[j] = merges[pair] & ID_MASK, -1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
        for a, b in ((left[i], i), (i, k)):
            if a >= 0 and b < n and (m := merges.get((parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (m, a, (parts[a], parts[b])))
    return [p for p in parts if p >= 0]


class Encoder(dict):
    """Word -> ids as int32 bytes; fills itself on a miss. When full, its words and pieces become the old ones, of which those met again come back."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        import regex

        self.v = vocabulary
        self.pieces = regex.compile(vocabulary.pattern).findall
        self.known: dict[str, bytes] = {}  # ids of pieces, which many words share
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def ids(self, piece: str) -> list[int]:
        parts = [self.v.byte_ids[b] for b in piece.encode()]
        return (merge_short if len(parts) <= LONG else merge_long)(parts, self.v.merges)

    def piece(self, piece: str) -> bytes:
        value = self.old_pieces.get(piece)
        if value is None:
            value = array("i", self.ids(piece)).tobytes()
        if len(piece) <= LONG:
            if len(self.known) >= PIECES:
                self.old_pieces, self.known = self.known, {}
            self.known[piece] = value
        return value

    def encode(self, word: str) -> bytes:
        found, known = self.pieces(word), self.known
        if len(found) == 1:
            return known.get(found[0]) or array("i", self.ids(found[0])).tobytes()
        return b"".join([known.get(p) or self.piece(p) for p in found])

    def __missing__(self, word: str) -> bytes:
        value = self.old_words.get(word)
        if value is None:
            value = self.encode(word)
        if len(word) <= LONG:
            if len(self) >= CACHED:
                self.old_words = dict(self)
                self.clear()
            self[word] = value
        return value

    def words(self, text: str) -> list[str]:
        return CHUNK.findall(text)

    def text_ids(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.v.special):
            return b"".join(map(self.__getitem__, CHUNK.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.v.special:
                out.append(array("i", [self.v.special[part]]).tobytes())
            else:
                out += map(self.__getitem__, CHUNK.findall(part))
        return b"".join(out)


def worker_encoder(shared) -> Encoder:
    """The encoder of this worker for a broadcast vocabulary."""
    return kept("bpe", shared.id, lambda: Encoder(shared.value))


class Shared:
    """A broadcast value with a key that workers can cache by."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._b = spark.sparkContext.broadcast(value)
        self.id = self._b._jbroadcast.id()

    def __getstate__(self):
        return {"_b": self._b, "id": self.id}

    @property
    def value(self):
        return self._b.value

    def passing(self):
        """The value, read anew by each call: a worker doesn't keep it when it has many to go through."""
        value = self._b.value
        if getattr(self._b, "_path", None) is not None:
            vars(self._b).pop("_value", None)
        return value


def vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Shared:
    """Read on the driver and broadcast: its size is that of a vocabulary file, not of data."""
    import public_tokenizers

    return Shared(spark, Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN))


class Decoder:
    """All token bytes in one array, from which those of a text are gathered at once."""

    def __init__(self, v: Vocabulary) -> None:
        self.size = np.array([len(t) for t in v.tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(v.tokens), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        n = self.size[ids]
        ends = np.cumsum(n)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[ids] - (ends - n), n)
        return self.data[index].tobytes().decode("utf-8", "replace")


def id_lists(code: Encoder, texts: list[str]) -> tuple[pa.Array, list[bytes]]:
    found = [code.text_ids(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32))), found


def encode(docs: DataFrame, vocab: Shared, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` array<int>: the token ids of each whole text.

    With ``decoded`` also the text those ids stand for, by the same worker, so that ids needn't travel back.
    """
    prepare(docs.sparkSession)
    narrow, at, schema = carried(docs, keep, text)

    def run(batches):
        code, back = worker_encoder(vocab), Decoder(vocab.value) if decoded else None
        for batch in slices(batches, at, 1 << 20):
            ids, found = id_lists(code, strings(batch.column(at)))
            more = [pa.array([back.text(np.frombuffer(x, np.int32)) for x in found], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], ids, *more], [*keep, "ids", *(["decoded"] if decoded else [])])

    return narrow.mapInArrow(run, f"{schema}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(coded: DataFrame, vocab: Shared, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; bytes that aren't UTF-8 become the replacement character."""
    prepare(coded.sparkSession)
    names = coded.columns
    at = names.index(ids)

    def run(batches):
        back = Decoder(vocab.value)
        for batch in batches:
            lists = batch.column(at)
            texts = ["" if x is None else back.text(np.asarray(x, dtype=np.int64)) for x in (s.values if s.is_valid else None for s in lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{schema}, `{out}` string")


def digests(docs: DataFrame, vocab: Shared, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token count and digests of ids and of the decoded text."""
    coded = encode(docs, vocab, text=text, keep=keep, decoded=True)
    return coded.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
