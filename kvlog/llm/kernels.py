"""Vectorised text kernels shared by the corpus operators.

Everything works on one block of an Arrow string column at a time: the UTF-8
bytes of several texts behind one another plus the offsets of each text. Blocks
are small (``BLOCK`` bytes, or one text if that is longer), so the temporaries
stay bounded whatever the size of an Arrow batch.

Hashes are 64-bit polynomial hashes over a random byte table, finished with a
mixer; two independent seeds give 128 bits where equality has to be trusted over
a whole corpus. They depend on the bytes only, so they agree across executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21
U64 = np.uint64
_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, x = [], seed & _MASK
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, U64)


#: ASCII white space: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_TABLES = {(seed, fold): t[FOLD] if fold else t for seed in (1, 2) for t in [_splitmix(seed, 256)] for fold in (False, True)}
_BASE = {seed: int(_splitmix(seed + 100, 1)[0]) | 5 for seed in (1, 2)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_WORD_MULTIPLIERS = _splitmix(77, 64) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, n.bit_length())
        base = _BASE[seed]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        _POWERS[seed] = have = (pair[0], pair[1])
    return have


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows; a null text is an empty one."""
    n = batch.num_rows
    if not n:
        return
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, where, what = arr.buffers()
    offs = np.frombuffer(where, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How often mask holds in each text."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, fold: bool = False) -> np.ndarray:
    """Hash of data[start:end] for every span; fold lower-cases A-Z first."""
    n = len(data)
    power, inverse = _powers(seed, n)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(_TABLES[seed, fold][data] * power[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between bytes of `space`, and the index of each text's first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the \n-separated lines (an empty text has one), and the index of each text's first line."""
    n = len(data)
    texts = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    count = np.searchsorted(breaks, offs)
    first = count + np.arange(texts + 1)
    starts = np.empty(len(breaks) + texts, np.int64)
    ends = np.empty_like(starts)
    starts[first[:-1]] = offs[:-1]
    ends[first[1:] - 1] = offs[1:]
    inner = np.ones(len(starts), bool)
    inner[first[:-1]] = False
    starts[inner] = breaks + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[inner] = breaks
    assert n == 0 or ends[-1] == n
    return starts, ends, first


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at both ends."""
    ink = np.flatnonzero(~SPACE[data])
    if not len(ink):
        return starts, starts.copy()
    at = np.searchsorted(ink, starts)
    upto = np.searchsorted(ink, ends)
    some = at < upto
    new_starts = np.where(some, ink[np.minimum(at, len(ink) - 1)], starts)
    new_ends = np.where(some, ink[np.maximum(upto - 1, 0)] + 1, starts)
    return new_starts, new_ends


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c[ends] - c[starts]


def windows(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside one text, and the index of each text's first window."""
    n = len(word_hashes) - k + 1
    counts = np.maximum(0, np.diff(first) - k + 1)
    index = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=index[1:])
    if n <= 0:
        return np.zeros(0, U64), index
    h = word_hashes[:n] * _WORD_MULTIPLIERS[0]
    for j in range(1, k):
        h = h + word_hashes[j : j + n] * _WORD_MULTIPLIERS[j]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(h)[text[:n] == text[k - 1 :]], index


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
