"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks

#: Between a character that isn't white space and a single space before another such character.
#: Byte-level splitters never join text across it, and no special token holds a space.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a ``.json`` file, loaded once in each Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


def pieces(text: str, most: int) -> list[tuple[str, int]]:
    """``text`` cut at safe boundaries into parts of about ``most`` bytes, each with its size.

    A part is longer where the text has no boundary; no character is lost and no token is split.
    """
    size = len(text) if text.isascii() else len(text.encode())
    if size <= most:
        return [(text, size)]
    step = max(1, most * len(text) // size)  # characters that take about that many bytes
    out, start = [], 0
    while len(text) - start > step:
        found = BOUNDARY.search(text, start + step)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return [(part, len(part) if part.isascii() else len(part.encode())) for part in out]


def count_lengths(texts: list[str | None], path: str, batch_bytes: int, piece_bytes: int) -> np.ndarray:
    """The number of tokens of each text; the library gets batches of about ``batch_bytes`` bytes."""
    counts, tok = np.zeros(len(texts), np.int64), tokenizer(path)
    owners: list[int] = []
    parts: list[str] = []
    held = 0

    def flush() -> None:
        np.add.at(counts, owners, [len(x) for x in tok.encode_batch_fast(parts, add_special_tokens=False)])
        owners.clear()
        parts.clear()

    for i, text in enumerate(texts):
        for part, size in pieces(text, piece_bytes) if text else ():
            if held and held + size > batch_bytes:
                flush()
                held = 0
            owners.append(i)
            parts.append(part)
            held += size
    if parts:
        flush()
    return counts


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", batch_bytes: int = 500_000, piece_bytes: int = 50_000) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` to ``docs``.

    Texts are encoded by the library without begin, end or added special tokens, special strings
    inside a text as its default has it. Null and empty texts have 0 bytes and 0 tokens. Rows are
    gathered to blocks of ``batch_bytes`` bytes of text, and a longer text is cut at safe
    boundaries, so the library gets batches of about that size and memory is bounded by them, the
    longest text and the longest run without a boundary. Rows are independent: repeated rows,
    null ids and tables without rows need no care; other columns pass through, except that older
    columns named ``n_bytes`` or ``n_tokens`` are replaced.
    """
    docs = docs.drop("n_bytes", "n_tokens")
    schema = docs.drop(text).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text, batch_bytes):
            counts = count_lengths(batch.column(text).to_pylist(), tokenizer_path, batch_bytes, piece_bytes)
            rest = [(n, batch.column(n)) for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(counts)], names=[n for n, _ in rest] + ["n_tokens"])

    sized = arrow_rows(docs).withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return sized.mapInArrow(run, schema)
