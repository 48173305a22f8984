"""Word and shingle hashes of many texts at once, with numpy on Arrow's buffers.

A word's hash is a polynomial of its bytes modulo 2 ** 64, taken from running
sums over all texts of a batch and then mixed; a shingle's hash mixes those of
its words in order. Equal words and shingles have equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of BASE modulo 2 ** 64.
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are hashed together, which bounds the arrays.
SLICE_BYTES = 1_000_000

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        one = np.ones(1, np.uint64)
        _powers[size] = tuple(np.concatenate([one, np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, UNBASE))
    return _powers[size]


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie one after another in ``data`` (bytes) between ``edges``: all words' hashes, and how many words each text has.

    A-Z count as a-z; words are parted by ASCII white space and by the edges.
    """
    n_texts = len(edges) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    inside = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    at_edge = edges[:-1][edges[:-1] < len(data)]
    before[at_edge] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = at_edge[at_edge > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    up, down = _power(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low + np.uint64(1)) * up[: len(data)], out=run[1:])
    hashes = mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))
    count = np.searchsorted(begin, edges[1:]) - np.searchsorted(begin, edges[:-1])
    return hashes, count


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n-word shingles of one text, in order; of the whole text if it has fewer words."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * MIX_B + words[i : len(words) - k + 1 + i])
    return out


def each_text(column: pa.Array):
    """For each text of a string column (nulls as empty), in order: its words' hashes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, len(column))
        hashes, count = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        at = np.concatenate([[0], np.cumsum(count)])
        for k in range(j - i):
            yield hashes[at[k] : at[k + 1]]
        i = j
