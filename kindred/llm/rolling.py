"""Hashes of all substrings of a buffer, and the anchors that stand for its windows.

A window of ``length`` items is represented by the least hash among the ``length - k + 1`` k-item
pieces in it (its minimizer). Equal windows have equal minimizers at equal offsets, and windows that
follow one another mostly share one, so a run of them is one *zone*: anchor hash, first window, number
of windows, and the hash of all items that its windows cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U = np.uint64
_BASE, _MOD = 0xD6E8FEB86659FD93, 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer buffer comes."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, _MOD)
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p))


_POWERS = Powers()
#: Bits of a piece's hash that give way to its place; a buffer has fewer items.
PLACE = U((1 << 22) - 1)
#: One random odd 64-bit value for each byte; the same in every process.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


#: The characters between words.
SPACE = b" \t\n\x0b\x0c\r"
_GAP = np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))
#: Bytes of text that are hashed at a time.
PART = 1 << 20
#: One random odd value for each place in a word; words of more bytes are hashed by XXH3.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)) | U(1)


def word_parts(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about PART bytes, none of which cuts a word."""
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + PART)
        if stop < n:
            cut = max(text.rfind(bytes([c]), at, stop) for c in SPACE)
            if cut < 0:  # a word that is longer than a part
                cut = min((p for c in SPACE if (p := text.find(bytes([c]), stop)) >= 0), default=n)
            stop = max(cut, at + 1)
        yield text[at:stop]
        at = stop


def word_hashes(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, bytes) of each word of ``part``; equal words have equal hashes everywhere.

    A hash is a sum of products of two random values, for the byte and for its place in the word, so no
    pattern of letters cancels as it can in powers of one base.
    """
    if len(part) > 2 * PART:  # one word, see word_parts
        word = part.strip(SPACE)
        return np.array([xxhash.xxh3_64_intdigest(word)], U)[: len(word)], np.array([len(word)], np.int64)[: len(word)]
    raw = np.frombuffer(part, np.uint8)
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    size = stop - start
    if not len(start):
        return np.empty(0, U), size
    letters, first = raw[~gap], np.cumsum(size) - size
    place = np.minimum(np.arange(len(letters)) - np.repeat(first, size), len(PLACES) - 1)
    values = mix(np.add.reduceat(BYTE[letters] * PLACES[place], first) + size.astype(U) * U(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(size > len(PLACES)).tolist():
        values[i] = xxhash.xxh3_64_intdigest(part[start[i] : stop[i]])
    return values, size


def digests(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """XXH3-128 of each slice of ``data``, as two columns of signed 64-bit values."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    out = b"".join([digest(view[s:e]) for s, e in zip(start.tolist(), stop.tolist())])
    return np.frombuffer(out, ">i8").astype(np.int64).reshape(-1, 2)


class Sums:
    """Running hash sums of a buffer; ``span(s, e)`` is the hash of items s to e, wherever they stand."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        _POWERS.grow(n + 1)
        self.h = np.zeros(n + 1, U)
        np.cumsum(values * _POWERS.up[:n], out=self.h[1:])

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.h[e] - self.h[s]) * _POWERS.down[s])

    def pieces(self, k: int) -> np.ndarray:
        n = len(self.h) - 1
        return mix((self.h[k:] - self.h[:-k]) * _POWERS.down[: n - k + 1])


def least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, by doubling."""
    m, s = h, 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: len(m) - (w - s)], m[w - s :]) if s < w else m


def zones(sums: Sums, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, zone hash, first window, windows) for a buffer of documents that end at ``ends``.

    Places are those of the buffer. Windows never cross documents. A zone's hash covers its items and their number.
    """
    n = len(sums.h) - 1
    if n > int(PLACE):
        raise ValueError("the buffer is too long")
    none = np.empty(0, np.int64)
    if n < length:
        return none.astype(U), none.astype(U), none, none
    h = sums.pieces(k)
    # The first of equal pieces counts, so that no window comes twice in a zone: places are part of the order.
    m = least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - k + 1) & PLACE
    place = np.arange(len(m))
    doc_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(m)]
    valid = place + length <= doc_end
    new = valid.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    edge = np.append(np.flatnonzero(new | ~valid), len(m))
    last = edge[np.searchsorted(edge, first, side="right")]
    whole = sums.span(first, last - 1 + length)
    return h[m[first].astype(np.int64)], mix(whole ^ (last - first).astype(U)), first, last - first
