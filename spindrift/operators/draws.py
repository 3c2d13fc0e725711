"""The numbers of ``portable_hash`` made in numpy: md5 of many short messages at a time.

Draws by definition are md5 of "seed-number-place", billions of them on larger tables. A message of
them differs from its neighbour in few bytes, so all steps run on arrays of messages of one length,
and steps that read only what the messages share run once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

AT_ONCE = 32_768  # messages hashed together: their arrays stay in a core's cache
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [n for of in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in of * 4]
WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
FIRST = 61  # steps after which the first word of the state is final


def _steps(state: list[np.ndarray], words: list, start: int, end: int) -> list[np.ndarray]:
    """``state`` (a, b, c, d, overwritten) after steps ``start`` to ``end`` over 16 words: numbers, or arrays that broadcast to its shape."""
    a, b, c, d = state
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(start, end):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word, more = words[WORD[i]], ADDED[i]
        if isinstance(word, int):
            more = (more + word) & 0xFFFFFFFF
        else:
            np.add(f, word, out=f)
        np.add(f, np.uint32(more), out=f)
        np.left_shift(f, np.uint32(TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [a, b, c, d]


def hashes(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5 of each of ``heads`` followed by each of ``tails``, a row per head.

    Both are byte matrices, a row for each text of one length.
    """
    n, p, m, size = len(heads), heads.shape[1], len(tails), tails.shape[1]
    blocks = (p + size + 8) // 64 + 1
    words: list = [0] * (16 * blocks)
    at = p // 4
    left = np.zeros((n, 4 * (at + 1)), np.uint8)
    left[:, :p] = heads
    for i, column in enumerate(np.ascontiguousarray(left).view("<u4").T):
        words[i] = np.ascontiguousarray(column)[:, None]
    right = np.zeros((m, 4 * ((p % 4 + size) // 4 + 1)), np.uint8)
    right[:, p % 4 : p % 4 + size] = tails
    right[:, p % 4 + size] = 0x80
    for i, column in enumerate(right.view("<u4").T, at):
        words[i] = words[i] | column[None, :] if i == at else np.ascontiguousarray(column)[None, :]
    bits = 8 * (p + size)
    words[-2], words[-1] = bits & 0xFFFFFFFF, bits >> 32
    state = [np.full((n, 1), x, np.uint32) for x in START]
    for block in range(blocks):
        own, last, shared = words[16 * block : 16 * block + 16], block == blocks - 1, min(16, max(0, at - 16 * block))
        made = _steps([x.copy() for x in state], own, 0, shared)
        if at < 16 * block + 16:
            made = [np.broadcast_to(x, (n, m)).copy() for x in made]
        made = _steps(made, own, shared, FIRST if last else 64) if made[0].shape[1] == m else _steps(made, own, shared, 64)
        if last:  # after 61 steps the word that ends as the first is the second
            return (made[1] + state[0]).byteswap()
        state = [x + y for x, y in zip(made, state, strict=True)]
    raise AssertionError("no block")


def same_lengths(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes of strings (no nulls) of equal lengths, at most ``AT_ONCE`` at a time."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, sizes = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.diff(offsets)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for i in range(0, len(own), AT_ONCE):
            places = own[i : i + AT_ONCE]
            yield places, data[offsets[places][:, None] + np.arange(size)]


def numbers(start: int, end: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of the whole numbers from ``start`` on, not negative, before ``end``, of at most ``AT_ONCE``: first, end and decimal digits."""
    while start < end:
        size = len(str(start))
        stop = min(end, start + AT_ONCE, 10**size)
        yield start, stop, np.arange(start, stop).astype(f"S{size}").view(np.uint8).reshape(-1, size)
        start = stop


def heads(seed: int, start: int, end: int, tails: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First, end and bytes of "seed-b" for ranges of b, of as many as make about ``AT_ONCE`` messages with ``tails`` tails."""
    first, most = np.frombuffer(str(seed).encode(), np.uint8), max(1, AT_ONCE // max(1, tails))
    for low, high, digits in numbers(start, end):
        for i in range(low, high, most):
            j = min(high, i + most)
            yield i, j, np.concatenate([np.tile(first, (j - i, 1)), np.full((j - i, 1), 45, np.uint8), digits[i - low : j - low]], axis=1)
