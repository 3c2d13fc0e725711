"""Byte-level BPE by corpus-level merge replay.

The words of a block of texts are laid out as one array of tokens. An inverted index holds, for
each pair of neighbouring tokens that can merge, the positions where it stands. Merges are taken
from the index in rank order; each is applied to all of its positions at once, and only the pairs
with the touched neighbours are looked up and indexed again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_rows, blocks

NONE = np.iinfo(np.int32).max
_LOADED: dict = {}


class Vocabulary:
    """Token ids of a rank file and the ranks of all mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.text = [str(i) for i in range(self.size)]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(keys) if keys else np.zeros(0, np.int64)
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in _LOADED:
            with open(path, "rb") as lines:
                _LOADED[path] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        return _LOADED[path]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is none."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.values[at], NONE)


def one_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """A single word by the rule itself: merge the leftmost pair of least rank, again and again.

    Pairs wait in a heap by rank and place; one that a merge has changed is passed over.
    """
    ranks, n = vocabulary.ranks, len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def put(i: int) -> None:
        j = following[i]
        if j < n and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, len(parts[i]) + len(parts[j])))

    for i in range(n):
        put(i)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = following[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i] += parts[j]
        parts[j] = None
        following[i] = following[j]
        if following[i] < n:
            before[following[i]] = i
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [ranks[p] for p in parts if p is not None]


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The token ids of each word; words are not empty and are merged apart from each other.

    A merge that makes a pair of a lower rank than its own, if only until its neighbour is merged
    too, could come before another merge of the same word; such words, which trained vocabularies
    hardly have, are merged again one by one.
    """
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    token = vocabulary.byte_ids[raw]
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[starts + sizes - 1] = -1
    before[starts] = -1
    rank = np.full(n, NONE, np.int32)
    pairs = np.flatnonzero(following >= 0)
    rank[pairs] = vocabulary.pair_ranks(token[pairs], token[pairs + 1])
    alive, again = np.ones(n, bool), []
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(positions: np.ndarray) -> None:
        ranks = rank[positions]
        positions = positions[ranks != NONE]
        if not len(positions):
            return
        ranks = rank[positions]
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate([[0], edges])].tolist(), np.split(positions, edges), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    put(pairs)
    while heap:
        now = heapq.heappop(heap)
        found = index.pop(now)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[rank[at] == now]
        if not len(at):
            continue
        if len(at) > 1:
            at.sort()
            touching = at[1:] == following[at[:-1]]
            if touching.any():  # of a run like aaaa, every other pair from the left
                i = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.concatenate([[True], ~touching]), i, 0))
                at = at[(i - first) % 2 == 0]
        gone = following[at]
        after = following[gone]
        if len(at) > 1 and (beside := np.flatnonzero(after[:-1] == at[1:])).size:  # of two side by side, the left one comes first
            between = vocabulary.pair_ranks(np.full(len(beside), now), token[at[beside + 1]])
            again.append(at[beside[between < now]])
        token[at] = now
        alive[gone] = False
        rank[gone] = NONE
        following[at] = after
        has = after >= 0
        before[after[has]] = at[has]
        rank[at] = NONE
        right = at[has]
        rank[right] = vocabulary.pair_ranks(token[right], token[after[has]])
        left = before[at]
        left = left[left >= 0]
        rank[left] = vocabulary.pair_ranks(token[left], token[following[left]])
        touched = np.unique(np.concatenate([right, left]))
        if len(touched):
            if (lower := rank[touched] < now).any():
                again.append(touched[lower])
            put(touched)
    ids = token[alive].tolist()
    ends = np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64)).tolist()
    out = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    for i in np.unique(np.searchsorted(starts, np.concatenate(again), side="right") - 1).tolist() if again else ():
        out[i] = one_word(words[i], vocabulary)
    return out


class Encoder:
    """Encodes texts, remembering at most ``most`` words between blocks."""

    def __init__(self, path: str, pattern: str, most: int):
        self.vocabulary, self.find, self.most = Vocabulary.load(path), regex.compile(pattern).findall, most
        self.known: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(self.vocabulary.size))  # one object for each id

    def learn(self, words: set[str]) -> None:
        todo: list[str] = []
        coded: list[bytes] = []
        for word in words:
            raw = word.encode()
            if (whole := self.vocabulary.ranks.get(raw)) is not None:
                self.known[word] = (self.numbers[whole],)
            else:
                todo.append(word)
                coded.append(raw)
        number = self.numbers.__getitem__
        for word, ids in zip(todo, replay(coded, self.vocabulary), strict=True):
            self.known[word] = tuple(map(number, ids))

    def block(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        self.learn(set().union(*split).difference(self.known))
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in split]


def encoder(path: str, pattern: str, most: int) -> Encoder:
    """One encoder in each Python worker."""
    key = (path, pattern, most)
    if key not in _LOADED:
        _LOADED[key] = Encoder(*key)
    return _LOADED[key]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, block_bytes: int, most_words: int) -> Iterator[pa.RecordBatch]:
    """Batches of texts to the same with ``ids`` in the text's place."""
    coder = encoder(path, pattern, most_words)
    for part in blocks(batches, text, block_bytes):
        coded = coder.block(part.column(text).to_pylist())
        offsets = np.zeros(len(coded) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)), out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(offsets[-1]))
        rest = [n for n in part.schema.names if n != text]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*rest, "ids"])


def lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of an array of ids, empty for null; much faster than the array's own conversion."""
    ends = column.offsets.to_pylist()
    ids = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).tolist()
    return [ids[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``ids`` to the same with ``decoded`` bytes added."""
    tokens = Vocabulary.load(path).tokens
    for batch in batches:
        made = pa.array([b"".join([tokens[i] for i in ids]) for ids in lists(batch.column("ids"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "decoded"])


def _without(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in names])


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", block_bytes: int = 12_000_000, most_words: int = 400_000) -> DataFrame:
    """``docs`` with ``ids`` (array of int) instead of ``text``.

    Every match of ``pattern`` is encoded by itself; null and empty texts have no ids. Texts are
    taken whole, in blocks of ``block_bytes``, a longer one in a block of its own; a block's new
    words are one corpus for the replay, and up to ``most_words`` words are remembered between
    blocks. Equal ranks of a word go from the left. Rows are independent, so repeated ones and null
    ids stay and no rows give none; other columns pass through, an older column ``ids`` is replaced.
    """
    docs = docs.drop("ids")
    schema = _without(docs.schema, text).add("ids", T.ArrayType(T.IntegerType(), False))
    return arrow_rows(docs).mapInArrow(lambda it: encode_batches(it, path, pattern, text, block_bytes, most_words), schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary) added: the bytes of ``ids``; null ids have none.

    Ids may cut a character, so the result is bytes, not text. An older column ``decoded`` is replaced.
    """
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(lambda it: decode_batches(it, path), schema)
