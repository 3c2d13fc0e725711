"""Packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, blocks, cut, release

#: Letters whose lower case is one letter, composed as it stands, and marks that may follow them.
LETTER, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", ".,;:!?"
LETTERS = re.compile(f"{LETTER}+").fullmatch
UPPER = [chr(i) for i in (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))]
LITTLE = [struct.Struct(f"<{n}I") for n in range(10)]
_LOADED: dict = {}


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    For tokenizers that drop white space and never join text across it: each word between white
    space is encoded by the library once and remembered, at most ``most`` words.
    """

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.folds = self.encode(UPPER) == self.encode([c.lower() for c in UPPER])  # letters are lowered

    def learn(self, units: list[str]) -> None:
        """Runs of letters are encoded many at a time and cut where one ends; other words, and all
        where that doesn't add up, are encoded singly."""
        letters = [u for u in units if LETTERS(u)] if self.ends.any() else []
        if letters:
            found = self.tokenizer.encode_batch_fast([" ".join(letters[i : i + 500]) for i in range(0, len(letters), 500)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(letters):
                raw, at = ids.tobytes(), ends.tolist()
                self.known.update(zip(letters, [raw[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
                units = [u for u in units if not LETTERS(u)]
        self.known.update(zip(units, self.encode(units), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() if len(x) > 9 else LITTLE[len(x)].pack(*x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and where each text's begin, with the end of the last.

        Words are split and told apart in Arrow, at ASCII white space: any other belongs to a word,
        which the library splits as it would in the text. A word of letters and marks after them is
        two units to the tokenizer; any other word is one here.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        letters = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(letters, f"^{LETTER}+$")
        units = pc.if_else(plain, pc.utf8_lower(letters) if self.folds else letters, words).dictionary_encode()
        marks = np.zeros(len(words), np.int64)  # the place of a word's marks behind all units, 0 for none
        marked = np.flatnonzero(plain.to_numpy(zero_copy_only=False) & (pc.binary_length(words).to_numpy() > pc.binary_length(letters).to_numpy()))
        ends_in = pc.replace_substring_regex(words.take(pa.array(marked)), f"^{LETTER}+", "").dictionary_encode()
        marks[marked] = ends_in.indices.to_numpy() + 1
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        tails = ["", *ends_in.dictionary.to_pylist()]
        if len(self.known) > self.most:
            self.known.clear()
        new = [u for u in (*names, *tails) if u not in self.known]
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        raw = list(map(self.known.__getitem__, (*names, *tails)))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first = np.cumsum(sizes) - sizes
        parts = np.stack([units.indices.to_numpy().astype(np.int64)[at], len(names) + marks[at]], axis=1).ravel()
        every = sizes[parts]
        ends = np.concatenate([[0], np.cumsum(every)])
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(first[parts] - ends[:-1], every) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return ids, ends[2 * (offsets - offsets[0])]


def word_encoder(path: str, most: int) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path, most)
    return _LOADED[path]


def plan_packs(histogram: dict[int, int], most: int) -> list[tuple[int, list[int]]]:
    """Packing patterns with their counts: every length of the histogram is placed, longest first.

    A length goes into the shortest open pack, the one with most room; the packs of one pattern
    move together, as many of them as there are pieces left. What doesn't fit opens new packs.
    """
    opened: dict[int, list[tuple[int, tuple | None]]] = {}  # room left -> (count, pattern as a linked list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in opened if r >= length), default=0)
            if not room:
                opened.setdefault(most - length, []).append((left, (length, None)))
                break
            count, pattern = opened[room].pop()
            used = min(count, left)
            if count > used:
                opened[room].append((count - used, pattern))
            if not opened[room]:
                del opened[room]
            opened.setdefault(room - length, []).append((used, (length, pattern)))
            left -= used
    out = []
    for room in sorted(opened):
        for count, pattern in opened[room]:
            lengths = []
            while pattern:
                lengths.append(pattern[0])
                pattern = pattern[1]
            out.append((count, lengths[::-1]))
    return out


class Slots:
    """For each length, which ranks go to which pattern, sequences and offsets."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        rows, ranks, first = [], {}, 0
        for count, lengths in patterns:
            offset = 0
            for length in sorted(set(lengths), reverse=True):
                times = lengths.count(length)
                low = ranks.get(length, 0)
                rows.append((length, low, times, first, offset, sum(lengths)))
                ranks[length] = low + count * times
                offset += times * length
            first += count
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 6)
        self.keys = (self.table[:, 0] << 45) + self.table[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sequence_id, offset and the sequence's tokens of pieces by length and rank."""
        row = self.table[np.searchsorted(self.keys, (length << 45) + rank, side="right") - 1]
        nth, slot = np.divmod(rank - row[:, 1], row[:, 2])
        return row[:, 3] + nth, row[:, 4] + slot * length, row[:, 5]


PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType())]


def cut_documents(docs: DataFrame, tokenizer_path: str, most: int, end_id: int, id_col: str, text: str, with_ids: bool, block_bytes: int = 2_000_000, most_words: int = 800_000) -> DataFrame:
    """One row per piece of a tokenized document: full pieces of ``most`` ids, then the rest."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in PIECE)])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_encoder(tokenizer_path, most_words), np.array([end_id], "<u4").tobytes()
        for part in blocks(batches, text, block_bytes):
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            coded, bounds = coder.block(part.column(text))
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                raw = coded[a:b].tobytes() + end
                n = len(raw) // 4
                for at in range(0, n, most):
                    piece = raw[4 * at : 4 * (at + most)]
                    owner.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = [part.column(id_col).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        coder.known.clear()  # full long before a task ends, it is worth little to the next one
        release()

    return arrow_rows(docs).select(id_col, text).mapInArrow(run, schema)


def ranked(pieces: DataFrame, histogram: dict[int, int], rows_per_group: int = 2000) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps among the pieces of each length.

    One length may hold most pieces, so each is dealt by hash into as many groups as its number
    needs, up to 64 small ones before they grow to ``rows_per_group``: ranks within a group are
    shifted by the sizes of the groups before it.
    """
    needed = lambda n: max(1, -(-n // rows_per_group), min(64, -(-n // 64)))
    sizes_of = [needed(histogram.get(n, 0)) for n in range(1, max(histogram, default=1) + 1)]
    groups = F.element_at(F.split(F.lit(",".join(map(str, sizes_of))), ",").cast("array<int>"), F.col("length").cast("int"))  # folded to a constant
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "ids"]), groups))
    sizes = dealt.groupBy("length", "__group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy("length", "__group").orderBy(*[c for c in pieces.columns if c not in ("ids", "length")])
    numbered = dealt.withColumn("__n", F.row_number().over(within))
    return numbered.join(shifts, ["length", "__group"]).withColumn("rank", F.col("__n") - 1 + F.col("__shift")).drop("__group", "__n", "__shift")


def pack_documents(docs: DataFrame, tokenizer_path: str, most: int = 4096, end_id: int = 2, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack tokenized documents into sequences of at most ``most`` tokens.

    Returns one row per piece: the id, ``start`` (the document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in its sequence,
    gapless from 0), ``sequence_tokens`` and, with ``with_ids``, the piece's ``ids``. Every id of a
    document, its end id included, is in exactly one piece.

    The lengths' histogram, ``most`` numbers, is all that reaches the driver; the patterns planned
    there, whose number depends on ``most`` and not on the corpus, go back to the executors, and a
    piece finds its place by its rank among the pieces of its length.

    Null and empty texts are packed as their end id alone; very long ones are encoded whole and cut
    into pieces. Repeated rows and null ids are packed like any others; equal rows are ties whose
    places may be exchanged. Other columns, whatever their names, are left out. Without rows the
    result has none.
    """
    pieces = cut(cut_documents(docs, tokenizer_path, most, end_id, id_col, text, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(plan_packs(histogram, most))
    own = pieces.columns
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "sequence_tokens"))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = slots.place(*(batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *map(pa.array, found)], names=schema.names)

    return ranked(pieces, histogram).mapInArrow(place, schema)
