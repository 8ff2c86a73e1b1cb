"""Vectorised words, lines and hashes of UTF-8 texts held in Arrow buffers.

Words are maximal runs of bytes other than space and \\t to \\r. All functions work on whole texts; texts are
taken in small slices, and one very long text in chunks cut at white space, so that memory stays bounded.
Hashes are 64-bit: 8 bytes at a time are mixed with their place, summed, and mixed again with the length. No step is a
polynomial over bytes, whose values modulo 2 ** 64 coincide for some long words of regular build.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 150_000  #: bytes of text worked on at once; their arrays then fit a core's cache
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % 2**64))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def binaries(rows: np.ndarray) -> pa.Array:
    """The rows of an array of two dimensions as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    off = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows)])


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _runs(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in ``part``, where a new text begins at each of ``cuts``."""
    inside = ~SPACE[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(part))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U)  #: masks of the first n bytes


def eights(part: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each place, the one behind the end included, as little-endian numbers; zeros follow the end."""
    return np.ndarray((len(part) + 1,), "<u8", np.concatenate([part, np.zeros(8, np.uint8)]), strides=(1,))


def _blocks(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans as numbers of 8 bytes, one at least: the numbers, the place of each in its span, and where spans begin."""
    n = ends - starts
    view = eights(part)
    count = np.maximum((n + 7) >> 3, 1)
    if len(n) == 0 or count.max() == 1:
        return view[starts] & _KEEP[n], np.zeros(len(n), U), np.arange(len(n))
    begin = np.cumsum(count) - count
    place = np.arange(begin[-1] + count[-1]) - np.repeat(begin, count)
    at = np.repeat(starts, count) + 8 * place
    return view[at] & _KEEP[np.minimum(np.repeat(ends, count) - at, 8)], place.astype(U), begin


def span_digests(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, seconds: tuple[bool, ...] = (False, True)) -> list[np.ndarray]:
    """Hashes of part[starts[i]:ends[i]] for each i; a second one doesn't derive from the first."""
    if not len(starts):
        return [np.zeros(0, U) for _ in seconds]
    block, place, begin = _blocks(part, starts, ends)
    size = (ends - starts).astype(U) * U(0xA24BAED4963EE407)
    out = []
    for second in seconds:
        if second:
            w = block * U(0xC2B2AE3D27D4EB4F)
            w = mix(w ^ (w >> U(29)) ^ (place * U(0xD1342543DE82EF95) + U(0x3C79AC492BA7B653)))
        else:
            w = mix(block + place * U(0x9E3779B97F4A7C15) + U(0x1C69B3F74AC4AE35))
        out.append(mix((np.add.reduceat(w, begin) if len(begin) < len(w) else w) + size))
    return out


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_digests(part, starts, ends, (False,))[0]


def _chunks(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of about ``limit`` bytes that fall on white space; a longer word stays whole."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + limit)
        while end < n:
            gap = np.flatnonzero(SPACE[raw[end : end + limit]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + limit)
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 offsets into them by text. ``off`` may cover more than one slice."""
    if len(raw) <= 2 * SLICE:
        part = LOWER[raw] if lower else raw
        starts, ends = _runs(part, off)
        return span_hashes(part, starts, ends), np.searchsorted(starts, off)
    found, begun = [], []
    for a, b in _chunks(raw, SLICE):  # one very long text
        part = LOWER[raw[a:b]] if lower else raw[a:b]
        starts, ends = _runs(part, off - a)
        found.append(span_hashes(part, starts, ends))
        begun.append(starts + a)
    return np.concatenate(found), np.searchsorted(np.concatenate(begun), off)


_ROLL = [U(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows by text, with repeats; a text of fewer words has one for the whole sequence."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    soff = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return np.zeros(0, U), soff
    long = np.zeros(len(h), U)
    for j in range(k):
        long[: len(h) - j] += h[j:] * _ROLL[j]
    at = np.arange(soff[-1]) - np.repeat(soff[:-1], count) + np.repeat(woff[:-1], count)
    out = mix(long[at])
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = h[woff[i] : woff[i + 1]]
        x = len(own) * 0x27D4EB2F165667C5 + sum(int(w) * int(r) for w, r in zip(own, _ROLL, strict=False))
        out[soff[i]] = mix(np.array([x * 0x9E3779B97F4A7C15 % 2**64], U))[0]
    return out, soff


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    v = values.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a > 1:
            v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[off[:-1][off[:-1] < len(v)]] = True
    return v[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of all texts, and n + 1 offsets into them by text. An empty text has one empty line."""
    nl = np.flatnonzero(raw == 10)
    n = len(off) - 1
    owner = np.searchsorted(off, nl, side="right") - 1
    per = np.bincount(owner, minlength=n)[:n] + 1
    loff = np.concatenate([[0], np.cumsum(per)])
    starts, ends = np.empty(loff[-1], np.int64), np.empty(loff[-1], np.int64)
    starts[loff[:-1]] = off[:-1]
    ends[loff[1:] - 1] = off[1:]
    rank = np.arange(len(nl)) + owner  # nl[i] ends line i + owner and begins the next one
    ends[rank] = nl
    starts[rank + 1] = nl + 1
    return starts, ends, loff
