"""Byte-level BPE: texts to token ids and back.

A pre-token is a match of the vocabulary's pattern. Its merges run on a segment tree over byte
positions: leaf i holds the rank of the pair that begins at position i, inner nodes the smallest
(rank, position), so the root names the leftmost pair of the lowest rank. A merge kills one
position and changes the pairs of its live neighbours: three point updates of logarithmic cost,
so a pre-token of a megabyte costs n log n and not n squared. The trees of all pre-tokens of a
batch that the worker has not met before are advanced together, as rows of numpy arrays.

Defined results: a null text is empty and gives no ids; null ids decode to empty bytes; rows are
independent of each other, so repeated rows and ties give equal results; an empty table gives an
empty table. Input columns beyond those named are ignored. An id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from dayrank.llm.common import column, ready, map_arrow, slices

#: A vocabulary file beyond this is refused: every worker holds it.
VOCABULARY_BYTES = 64 << 20
#: Encoded pre-tokens a worker remembers; bounds memory, not results.
REMEMBERED = 200_000
#: Bytes of text, or of ids, worked on at once.
BATCH_BYTES = 1 << 20
#: Pre-tokens up to so many bytes have their trees advanced together, so many leaves at once;
#: a longer one has a tree of its own.
TOGETHER = 64
TREE_NODES = 1 << 18

_PLACE_BITS = 36
_PLACE = (1 << _PLACE_BITS) - 1
_NONE = np.int64(1 << 62)
#: Vocabularies this worker has parsed, by their bytes' hash.
_PARSED: dict[int, Vocabulary] = {}
_TOKENS: dict[int, Tokens] = {}


class Tokens:
    """The bytes of all tokens in the order of ids, and where each begins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=-1) + 1
        parts = [b""] * self.size
        for token, rank in ranks.items():
            parts[rank] = token
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError("a token id is not in the vocabulary")
        begin = self.starts[ids]
        length = self.starts[ids + 1] - begin
        end = np.cumsum(length)
        at = np.arange(end[-1]) + np.repeat(begin - (end - length), length)
        return self.bytes[at].tobytes()


class Vocabulary(dict):
    """Pre-token (str) to its ids (packed, 4 bytes each), for those met lately; ``old`` has those
    met before. When half of REMEMBERED is reached, what was met lately becomes old."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.split = regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        self.ranks = ranks
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("a vocabulary must hold all single bytes")
        # A token of n bytes can come from any of its n - 1 cuts whose halves are tokens.
        pairs = {
            ranks[token[:k]] * size + ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self.size = size
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [np.frombuffer(ids, dtype=np.int32).tolist() for ids in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        split = [self.split(text) if text else [] for text in texts]
        if 2 * len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        new = set().union(*split).difference(self)
        known = new.intersection(self.old)
        self.update((piece, self.old[piece]) for piece in known)
        self.update(self._merged(list(new - known)))
        get = self.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def _merged(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        by_leaves: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                yield piece, np.int32(whole).tobytes()
            elif len(raw) > TOGETHER:
                yield piece, np.array(merged(raw, self.ranks), dtype=np.int32).tobytes()
            else:
                by_leaves.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for leaves, group in by_leaves.items():
            step = max(1, TREE_NODES // leaves)
            for at in range(0, len(group), step):
                names, raws = zip(*group[at : at + step], strict=True)
                yield from zip(names, self._trees(raws, leaves), strict=True)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of ids the rank of what they merge to, or _NONE."""
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        found = (left >= 0) & (right >= 0)
        if not len(self.pair_keys):
            return np.full(len(keys), _NONE)
        return np.where(found & (self.pair_keys[at] == keys), self.pair_ranks[at], _NONE)

    def _trees(self, pieces: tuple[bytes, ...], leaves: int) -> list[bytes]:
        """One segment tree a piece, all of so many leaves, advanced together: each round does
        the next merge of every piece that has one."""
        count = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8)
        # The id of the token that begins at a position; the column behind the last stays -1.
        token = np.full((count, leaves + 2), -1, dtype=np.int64)
        token[:, :leaves] = self.byte_ids[raw.reshape(count, leaves)]
        token[np.arange(leaves + 2)[None, :] >= length[:, None]] = -1
        after = np.tile(np.arange(1, leaves + 3, dtype=np.int32), (count, 1))
        before = np.tile(np.arange(-1, leaves + 1, dtype=np.int32), (count, 1))
        tree = np.full((count, 2 * leaves), _NONE, dtype=np.int64)
        rank = self._ranks_of(token[:, :leaves].ravel(), token[:, 1 : leaves + 1].ravel())
        place = np.tile(np.arange(leaves), count)
        tree[:, leaves:] = _node(rank, place).reshape(count, leaves)
        width = leaves // 2
        while width:
            tree[:, width : 2 * width] = np.minimum(
                tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2]
            )
            width //= 2

        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            root = tree[row, 1]
            at = root & _PLACE
            gone = after[row, at]
            right = after[row, gone]
            left = before[row, at]
            token[row, at] = root >> _PLACE_BITS
            token[row, gone] = -1
            after[row, at] = right
            before[row, right] = at
            merged = token[row, at]
            tree[row, leaves + gone] = _NONE
            tree[row, leaves + at] = _node(self._ranks_of(merged, token[row, right]), at)
            has = left >= 0
            row_left, left = row[has], left[has]
            tree[row_left, leaves + left] = _node(
                self._ranks_of(token[row_left, left], merged[has]), left
            )
            nodes = np.concatenate([leaves + gone, leaves + at, leaves + left])
            rows = np.concatenate([row, row, row_left])
            while leaves > 1 and nodes[0] > 1:
                nodes = nodes >> 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            row = row[tree[row, 1] != _NONE]
        live = token >= 0
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        flat = token[live].astype(np.int32).tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _node(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A tree's entry: orders by rank, then by position."""
    return np.where(rank == _NONE, _NONE, (rank << _PLACE_BITS) | place)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long pre-token that is no token itself."""
    n = len(piece)
    get = ranks.get
    base = 1 << max(0, (n - 2).bit_length())
    none = 1 << 62
    tree = [none] * (2 * base)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[base + i] = rank * n + i
    for k in range(base - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after = list(range(1, n + 1))  # of a live position, the next live one
    before = list(range(-1, n - 1))

    def put(at: int, rank: int | None) -> None:
        k = base + at
        tree[k] = value = none if rank is None else rank * n + at
        while k > 1:
            value = min(value, tree[k ^ 1])
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    while tree[1] != none:
        i = tree[1] % n
        gone = after[i]
        right = after[gone]
        after[i] = right
        if gone < n - 1:
            put(gone, None)
        put_right = None
        if right < n:
            before[right] = i
            put_right = get(piece[i : after[right]])
        put(i, put_right)
        left = before[i]
        if left >= 0:
            put(left, get(piece[left:right]))

    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def _read(raw: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in lines}


def parsed(raw: bytes, pattern: str) -> Vocabulary:
    """The vocabulary for encoding; a worker keeps it until its task ends."""
    key = hash((raw, pattern))
    if key not in _PARSED:
        _PARSED.clear()
        _PARSED[key] = Vocabulary(_read(raw), pattern)
    return _PARSED[key]


def tokens(raw: bytes) -> Tokens:
    """The vocabulary for decoding, which is much smaller; a worker keeps the last."""
    key = hash(raw)
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = Tokens(_read(raw))
    return _TOKENS[key]


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The file of ranks, sent to the workers; its size is bounded by VOCABULARY_BYTES."""
    with open(path, "rb") as file:
        raw = file.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} holds more than {VOCABULARY_BYTES} bytes")
    return ready(spark).sparkContext.broadcast(raw)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(vocabulary: Broadcast, pattern: str, id_col: str, text_col: str) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = parsed(vocabulary.value, pattern)
        for batch in slices(batches, text_col, BATCH_BYTES):
            packed = words.packed(column(batch, text_col).to_pylist())
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([column(batch, id_col), ids], [id_col, "ids"])
        _PARSED.clear()  # the worker may go on to other work

    return run


def _decoding(vocabulary: Broadcast) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(vocabulary.value)
        for batch in slices(batches, "ids", BATCH_BYTES):
            lists = column(batch, "ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum([len(x) if x.is_valid else 0 for x in lists]) if len(lists) else []
            texts, at = [], 0
            for end in ends:
                texts.append(known.decode(flat[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"]
            )

    return run


def encode(
    docs: DataFrame, vocabulary: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids): the token ids of every whole text, special tokens treated as plain text."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = _encoding(vocabulary, pattern, id_col, text_col)
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(frame: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """The frame with ``decoded``, the bytes its ``ids`` stand for; a column of that name goes."""
    frame = frame.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return map_arrow(frame, _decoding(vocabulary), f"{schema}, decoded binary")


def encode_and_decode(
    docs: DataFrame, vocabulary: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids, decoded) as by ``encode`` and then ``decode``, both by the same worker: a task has one
    Python process instead of two, and ids do not go back and forth."""
    kind = docs.schema[id_col].dataType.simpleString()
    encoding, decoding = _encoding(vocabulary, pattern, id_col, text_col), _decoding(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoding(encoding(batches))
        _TOKENS.clear()

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
