"""Words [^\\x20\\x09-\\x0D]+ of Arrow string columns as 64-bit hashes, computed for many documents at once.

Sums of powers modulo 2 ** 64 can be made to collide by strings of a thousand bytes and more (of the kind that
doubles itself with its complement), so words over LONG bytes are hashed by xxh3 instead.
"""

import functools

import numpy as np
import pyarrow as pa
import xxhash

LONG = 64
#: Multipliers of the hash mix (odd 64-bit constants).
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(GOLDEN) + (right ^ np.uint64(MIX_B)))


#: Bytes that are hashed at once.
BLOCK = 1 << 18


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for the bytes of a block and of a word that begins in it."""
    out = np.ones((2, BLOCK + LONG), np.uint64)
    for x, base in zip(out, (BASE, pow(BASE, -1, 1 << 64)), strict=True):
        x[1:] = base
        np.cumprod(x, out=x)
    return out[0], out[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins and ends (n + 1 offsets); null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """hash: of each word; first: index of the first word of each text, and the number of words at the end; text: the text of each word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, at = text_bytes(texts)
        n = len(data)
        ink = ~SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[at] = True
        start = np.flatnonzero(ink & (begins[:-1] | ~np.concatenate(([False], ink[:-1])))) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(ink & (begins[1:] | ~np.concatenate((ink[1:], [False])))) + 1 if n else np.zeros(0, np.int64)
        power, inverse = powers()
        table, self.hash = LOWER if lower else BYTES, np.empty(len(start), np.uint64)
        cut = np.searchsorted(start, np.arange(0, n + BLOCK, BLOCK))
        for k, low in enumerate(range(0, n, BLOCK)):
            part, here = data[low : low + BLOCK + LONG], slice(cut[k], cut[k + 1])
            s, e = start[here] - low, np.minimum(end[here] - low, len(part))  # longer words follow below
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * power[: len(part)], out=total[1:])
            self.hash[here] = mix((total[e] - total[s]) * inverse[s] + (end[here] - start[here]).astype(np.uint64) * np.uint64(GOLDEN))
        long = np.flatnonzero(end - start > LONG)
        if len(long):
            raw = (LOWERED[data] if lower else data).tobytes()
            self.hash[long] = [xxhash.xxh3_64_intdigest(raw[b:e]) for b, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        self.first = np.searchsorted(start, at)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.start, self.end = start, end

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on, itself included."""
        return self.first[self.text + 1] - np.arange(len(self.hash))


def runs(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values from each place on, by doubling; the last n - 1 are without meaning."""
    if n == 1:
        return word
    half = runs(word, n // 2)
    out = combine(half, shifted(half, n // 2))
    return combine(out, shifted(word, n - 1)) if n % 2 else out


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate((x[by:], np.zeros(min(by, len(x)), x.dtype)))


def slices(texts: pa.Array, most: int = 2_000_000, rows: int = 20_000):
    """(begin, end) of runs of at most so many rows with at most so many bytes of text, or of one row."""
    sizes = np.diff(text_bytes(texts)[1])
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (total + size > most or i - begin == rows):
            yield begin, i
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield begin, len(sizes)
