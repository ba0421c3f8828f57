"""Words of texts as 64-bit hashes, for whole batches at a time."""

from __future__ import annotations

import functools

import numpy as np

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
S32, S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> S32)) * M2
    x = (x ^ (x >> S29)) * M1
    return x ^ (x >> S32)


@functools.cache
def tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """A-Z lowered; which bytes are word characters; masks of 0 to 8 bytes.

    All bytes of a character above U+007F are at least 0x80, so words of
    UTF-8 can be cut by byte.
    """
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    word = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    return lower, word, masks


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, counts): the words of all texts in order, with
    byte offsets into the joined texts (one byte between two), and the number
    of words of each text."""
    lower, is_word, masks = tables()
    joined = b"\n".join(texts).translate(lower)
    n = len(joined)
    flags = np.zeros(n + 2, np.int8)
    flags[1:-1] = is_word[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[::2], edges[1::2]
    loads = np.ndarray((n + 1,), "<u8", joined + b"\0" * 8, strides=(1,))
    sizes = ends - starts
    hashes = mix(sizes.astype(np.uint64) * M1 ^ (loads[starts] & masks[np.minimum(sizes, 8)]))
    left, done = np.flatnonzero(sizes > 8), 8
    while len(left):
        hashes[left] = mix(hashes[left] * M1 ^ (loads[starts[left] + done] & masks[np.minimum(sizes[left] - done, 8)]))
        done += 8
        left = left[sizes[left] > done]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    return hashes, starts, ends, counts


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of the `size` words from each word on; the last size - 1 words of
    the input have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = hashes[:n].copy()
    for k in range(1, size):
        found *= M1
        found ^= hashes[k : k + n]
        found ^= found >> S29
    return mix(found)
