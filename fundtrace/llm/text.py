"""Words, word hashes and sliding minima over Arrow text columns, vectorised with numpy.

Everything works on UTF-8 bytes. Batches are cut into pieces of a MB, so a task's memory doesn't follow
the number of rows in a batch; a document longer than a piece makes a piece of its own.
"""

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
PIECE_ROWS = 1024

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base % (1 << 64)
        np.multiply.accumulate(out, out=out)
    return out


def word_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE):
    """Words of the texts buf[starts[i]:ends[i]], which lie in order in buf: (first bytes, ends, words per text)."""
    inside = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[starts[starts < len(buf)]] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1] = False
        after[:-1] = inside[1:]
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    a, b = np.searchsorted(first, starts), np.searchsorted(first, ends)
    return first, last, b - a


#: Bytes that are hashed at a time: 8-byte arrays of a whole piece would be most of a task's memory.
HASHED = 1 << 16
_UP, _DOWN = powers(_BASE, HASHED), powers(pow(_BASE, -1, 1 << 64), HASHED)


def word_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random values of its bytes, scrambled. Words are in order, and none is empty."""
    out, i = np.empty(len(first), np.uint64), 0
    while i < len(first):
        a = int(first[i])
        j = max(i + 1, int(np.searchsorted(last, a + HASHED, "right")))
        n = int(last[j - 1]) - a
        up, down = (_UP, _DOWN) if n <= HASHED else (powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf[a : a + n]] * up[:n], out=total[1:])
        f, t = first[i:j] - a, last[i:j] - a
        out[i:j] = mix((total[t] - total[f]) * down[f] + (t - f).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, as if there were one text; the caller leaves out those across texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
    return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    return x


def pieces(ids: pa.Array, texts: pa.Array, most: int = PIECE_BYTES, rows: int = PIECE_ROWS):
    """Parts of a batch, of at most that many bytes (or one text) and rows: (ids, bytes, starts, ends). A null text is an empty one."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ids = np.asarray(ids.to_numpy(zero_copy_only=False))
    i = 0
    while i < len(ids):
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1), i + rows)
        base = offsets[i]
        yield ids[i:j], data[base : offsets[j]], offsets[i:j] - base, offsets[i + 1 : j + 1] - base
        i = j
