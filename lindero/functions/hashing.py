"""MD5 of many short texts at once, to rank pairs by it.

A message of at most 55 bytes is one block of MD5, so the digests of all pairs of two lists take the
64 steps of one block on whole arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: The longest message of one block, and the pairs that are hashed at once.
ONE_BLOCK, PAIRS = 55, 1 << 15

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476


def md5_heads(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first eight bytes of the digests, as numbers in the order of the digests. words: the 16 words of each block, of shapes that broadcast to shape."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f = np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            np.invert(d, f)
            f |= b
            f ^= c
        a += f
        a += words[_WORD[i]] + np.uint32(_K[i])
        np.left_shift(a, np.uint32(_TURNS[i]), f)
        a >>= np.uint32(32 - _TURNS[i])
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def _blocks(texts: list[bytes], at: int, end: bool) -> np.ndarray:
    """The 16 words of the block that holds each text from byte at on, with the padding of MD5 where it ends there."""
    out = np.zeros((len(texts), 64), np.uint8)
    for row, t in zip(out, texts):
        row[at : at + len(t)] = np.frombuffer(t, np.uint8)
        if end:
            row[at + len(t)] = 128
            row[56:58] = divmod(8 * (at + len(t)), 256)[::-1]
    return out.view("<u4")


def nearest_by_md5(left: list[bytes], right: list[bytes], n: int) -> Iterator[tuple[int, int, bytes]]:
    """For each of left the n of right with the smallest digests of both texts in a row, and any that share the last one's head: their places and the digest."""
    most = max(map(len, right), default=0)
    for size in sorted({len(x) for x in left}) if right else []:
        rows = [i for i, x in enumerate(left) if len(x) == size]
        if size + most > ONE_BLOCK:
            for i in rows:
                digests = [hashlib.md5(left[i] + y, usedforsecurity=False).digest() for y in right]
                for j in sorted(range(len(right)), key=digests.__getitem__)[:n]:
                    yield i, j, digests[j]
            continue
        ends = _blocks(right, size, True).T.copy()
        # A word that is the same in all blocks is one number.
        ends = [w[:1] if (w == w[0]).all() else w for w in ends]
        step = max(1, PAIRS // len(right))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            begins = _blocks([left[i] for i in some], 0, False)
            words = [e[None, :] | begins[:, w, None] if begins[:, w].any() else e[None, :] for w, e in enumerate(ends)]
            heads = md5_heads(words, (len(some), len(right)))
            last = np.partition(heads, n - 1, axis=1)[:, n - 1] if len(right) > n else np.full(len(some), np.iinfo(np.uint64).max)
            for i, j in zip(*np.nonzero(heads <= last[:, None])):
                yield some[i], int(j), hashlib.md5(left[some[i]] + right[j], usedforsecurity=False).digest()
