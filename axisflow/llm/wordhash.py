"""Words, word hashes and shingles of whole Arrow batches, computed with array arithmetic.

A word is a maximal run of bytes outside the six ASCII white-space characters, as in ``[^\\x20\\x09-\\x0D]+``.
Hashes are 64 bit and depend only on the bytes, so they agree between tasks, retries and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # bytes that are hashed at once, some fifty bytes of arrays each; a text may be longer

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text begins and ends; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at ends of texts, or at white space inside a text that is longer than a slice."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + SLICE)
        if end < n:
            at = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if at <= begin:
                gap = np.flatnonzero(IS_SPACE[data[begin:end]])
                if len(gap):
                    at = begin + int(gap[-1]) + 1
                else:  # one word longer than a slice
                    rest = np.flatnonzero(IS_SPACE[data[end:]])
                    at = end + int(rest[0]) + 1 if len(rest) else n
                    at = min(at, int(offsets[np.searchsorted(offsets, begin, "right")]))
            end = at
        yield begin, end
        begin = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in order: its hash, where it starts and where it ends in ``data``."""
    hashes, starts, ends = [], [], []
    for begin, end in _slices(data, offsets):
        part = data[begin:end]
        word = ~IS_SPACE[part]
        cut = offsets[np.searchsorted(offsets, begin, "left"):np.searchsorted(offsets, end, "left")] - begin
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = cut[(cut >= 0) & (cut < len(part))]
        first[cut] = word[cut]
        inner = cut[cut > 0]
        last[inner - 1] = word[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        up, down = _power(len(part))
        total = np.cumsum(_BYTE[_LOWER[part] if lower else part] * up[:len(part)])
        h = total[e - 1] - np.where(s > 0, total[s - 1], np.uint64(0))
        hashes.append(mix(h * down[s]))
        starts.append(s + begin)
        ends.append(e + begin)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of all words as one run if there are fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = out + hashes[i:n - k + 1 + i] * _STEP[i % 64]
    return mix(out)


def per_text(column: pa.Array, lower: bool = True, texts: int = 256) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column; those of at most ``texts`` texts are held at once."""
    for begin in range(0, len(column), texts):
        data, offsets = text_bytes(column.slice(begin, texts))
        h, s, _ = words(data, offsets, lower)
        at = np.searchsorted(s, offsets)
        for i in range(len(offsets) - 1):
            yield h[at[i]:at[i + 1]]
