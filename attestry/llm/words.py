"""Words and word shingles of Arrow text columns as 64-bit fingerprints, without a Python loop over words.

A word is a run of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. Its fingerprint is a polynomial over
its bytes modulo 2**64, taken from one running sum over the whole buffer, then mixed. Two given
words share a fingerprint with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C13  # odd, so that it has an inverse modulo 2**64
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    values[65:91] = values[97:123]
    return values


VALUES = _byte_values()
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def pieces(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, cuts) for runs of rows of about ``size`` bytes; null is empty.

    A row longer than ``size`` is a piece of its own and stays whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    cuts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(cuts, cuts[row] + size, side="right")) - 1)
        yield row, end, data[cuts[row] : cuts[end]], cuts[row : end + 1] - cuts[row]
        row = end


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and for each row (and once more for the end) the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
    full = ~SPACE[data]
    head, tail = full.copy(), full.copy()
    head[1:] &= ~full[:-1]
    tail[:-1] &= ~full[1:]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    head[inner] |= full[inner]
    tail[inner - 1] |= full[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(VALUES[data] * up, out=total[1:], dtype=np.uint64)
    prints = (total[end] - total[start]) * down[start]
    return mix(prints + (end - start).astype(np.uint64) * STEPS[0]), np.searchsorted(start, cuts)


def shingle_sets(data: np.ndarray, cuts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, one row after the other, and the index where each row starts.

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row without words has none.
    """
    prints, first = words(data, cuts)
    steps = mix(np.arange(1, width + 1, dtype=np.uint64) * STEPS[1]) | np.uint64(1)
    runs = np.zeros(max(0, len(prints) - width + 1), dtype=np.uint64)
    for k in range(width):
        runs += prints[k : k + len(runs)] * steps[k]
    runs = mix(runs + np.uint64(width))
    sets, starts, total = [], [0], 0
    for row in range(len(cuts) - 1):
        a, b = first[row], first[row + 1]
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix((prints[a:b] * steps[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            own = np.zeros(0, dtype=np.uint64)
        sets.append(own)
        total += len(own)
        starts.append(total)
    return np.concatenate(sets), np.array(starts, dtype=np.int64)
