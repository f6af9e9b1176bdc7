"""Vectorised byte kernels shared by the text operators.

All kernels work on one *slab*: the UTF-8 bytes of a few documents laid end to
end, plus the offsets that separate them.  Slabs are cut so that the temporary
arrays of a kernel stay within a fixed amount of memory, whatever the batch.
A null text is an empty document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 18

U64 = np.uint64
_GAMMA = 0x9E3779B97F4A7C15
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)

#: Word separators are space and the bytes 9 to 13.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * U64(_GAMMA) + U64(seed))


_BYTE = _stream(256, 11)
_PLACE = _stream(8, 23) | U64(1)
_BASE = U64(0xD6E8FEB86659FD93)


def slabs(texts: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes.

    A document longer than the limit makes a slab of its own.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slab, and for each document the index of its first word (one more entry: the total)."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1 : n + 1] = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets, "left")


#: Words up to this many bytes are hashed eight bytes at a time, longer ones byte by byte.
_SHORT = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    lengths = ends - starts
    long = np.flatnonzero(lengths > _SHORT)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each position
    with np.errstate(over="ignore"):
        out = (eight[starts] & _FIRST[np.minimum(lengths, 8)]) * _PLACE[0]
        for k in range(8, _SHORT, 8):
            at = np.flatnonzero((lengths > k) & (lengths <= _SHORT))
            if not len(at):
                break
            out[at] = (out[at] ^ (out[at] >> U64(29))) * _BASE + (eight[starts[at] + k] & _FIRST[np.minimum(lengths[at] - k, 8)]) * _PLACE[1]
        out = mix64(out + lengths.astype(np.uint64) * _PLACE[2])
    if len(long):
        out[long] = _long_word_hashes(data, starts[long], ends[long])
    return out


def _long_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE))
        values = _BYTE[data[np.repeat(starts, lengths) + place]] * powers[place]
        return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each document of a slab the sorted distinct hashes of its `width`-word shingles.

    A-Z count as a-z.  With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    return [x for x, _ in weighed_shingles(data, offsets, width)]


class Lookup:
    """Numbers by 64-bit hash: a table of slots by leading bits, and a search for hashes whose slot several share."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift = U64(64 - bits)
        slot = (self.keys >> self.shift).astype(np.int64)
        self.crowded = np.bincount(slot, minlength=1 << bits) > 1
        self.slot_key, self.slot_value = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=values.dtype)
        self.slot_key[slot], self.slot_value[slot] = self.keys, self.values

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, 0 for others."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=self.values.dtype)
        slot = (hashes >> self.shift).astype(np.int64)
        same = self.slot_key[slot] == hashes
        out = np.where(same, self.slot_value[slot], 0)
        other = np.flatnonzero(~same & self.crowded[slot])
        if len(other):
            at = np.minimum(np.searchsorted(self.keys, hashes[other]), len(self.keys) - 1)
            out[other] = np.where(self.keys[at] == hashes[other], self.values[at], 0)
        return out


def weighed_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5, level: Lookup | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """shingle_sets() with each shingle's sum of word levels."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    n = max(0, len(words) - width + 1)
    weight = None
    if level is not None:
        own = level(words).astype(np.int32)
        weight = sum((own[j : j + n] for j in range(width)), np.zeros(n, dtype=np.int32))
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            total += words[j : j + n] * _PLACE[j]
        total = mix64(total + U64(width))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                x = total[a : b - width + 1]
                order = None if weight is None else np.argsort(x)
                x = np.sort(x) if order is None else x[order]
                new = np.ones(len(x), dtype=bool)
                np.not_equal(x[1:], x[:-1], out=new[1:])
                out.append((x[new], None if order is None else weight[a : b - width + 1][order[new]]))
            elif b > a:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + U64(b - a)
                out.append((mix64(np.array([short], dtype=np.uint64)), np.zeros(1, dtype=np.int32)))
            else:
                out.append((words[:0], np.zeros(0, dtype=np.int32)))
    return out


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a little-endian word; the last 7 positions have none."""
    out = np.empty(max(0, len(data) - 7), dtype=np.uint64)
    for j in range(min(8, len(out))):
        whole = data[j : j + (len(data) - j) // 8 * 8].tobytes()
        out[j::8] = np.frombuffer(whole, dtype="<u8")[: len(out[j::8])]
    return out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position; k is 8 or more.  The last k-1 positions have none."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    eight = eight_bytes(data)
    with np.errstate(over="ignore"):
        out = eight[:n] * _PLACE[0]
        for i, at in enumerate([*range(8, k - 8, 8), k - 8][: max(1, k // 8)], 1):
            out = (out ^ (out >> U64(29))) * _BASE + eight[at : at + n] * _PLACE[i % 8]
        return mix64(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each window of w entries, by doubling."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    m = x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[w - span : w - span + n])
