"""Word hashes and shingle sets of whole texts, vectorised over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20_240_601)
_STEP = _U(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: The first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

#: A-Z lower-cased in UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words start (and the end).

    A word is a run of characters other than space and \\x09-\\x0D, A-Z lower-cased. Its hash takes in its bytes eight at a time, and its length.
    """
    coded = [(x or "").encode().translate(LOWER) for x in texts]
    raw = b" " + b" ".join(coded) + b" "
    data = np.frombuffer(raw + b"\0" * 8, np.uint8)
    seen = data[: len(raw)]
    space = (seen == 32) | (seen - np.uint8(9) < 5)  # unsigned: only \x09 to \x0D are under 5
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.lib.stride_tricks.as_strided(data, (len(raw) + 1, 8), (1, 1))
    hashes = mix((eight[start].view(np.uint64).ravel() & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        part = eight[start[more] + at].view(np.uint64).ravel() & _FIRST[np.minimum(size[more] - at, 8)]
        hashes[more] = mix(hashes[more] * _STEP + part)
        at += 8
        more = more[size[more] > at]
    begins = np.cumsum([1] + [len(x) + 1 for x in coded])
    return hashes, np.searchsorted(start, begins)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (as many as there are places for them)."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    total = words[:n] * _PLACE[0]
    for j in range(1, k):
        total = total + words[j : j + n] * _PLACE[j % 64]
    return mix(total)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; with fewer words the whole sequence as one; without words none."""
    words, first = word_hashes(texts)
    runs = shingle_hashes(words, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(shingle_hashes(words[a:b], int(b - a)) + _U(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprint(found: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    total = int(mix(found * _PLACE[3] + _PLACE[7]).sum(dtype=np.uint64)) + len(found) * int(_PLACE[5])
    return int(mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])
