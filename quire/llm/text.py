"""Vectorised byte-level text kernels shared by the corpus operators.

Every function works on whole Arrow string columns: the words of thousands of
documents are found, hashed and grouped with a few numpy passes over the UTF-8
buffer, so no Python loop runs per document or per word.  All separators used by
the operators are ASCII, hence splitting UTF-8 bytes equals splitting code points.

Nulls are treated as empty texts; empty texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for every byte.
BYTE_CODES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space: `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of alphanumeric words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        n2 = max(n, 1 << 16)
        for k, b in (("up", _BASE), ("down", _BASE_INV)):
            out = np.empty(n2, np.uint64)
            out[0] = 1
            filled = 1
            step = b
            while filled < n2:  # doubling: out[filled:2*filled] = out[:filled] * b**filled
                m = min(filled, n2 - filled)
                np.multiply(out[:m], step, out=out[filled : filled + m])
                filled += m
                step = np.uint64(int(step) ** 2 % 2**64)
            _powers[k] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole rows with about `budget` bytes of text each.

    Bounds a worker's memory; a longer text makes a run of its own and stays whole.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def words(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: maximal runs of bytes of `kind` within a row."""
    inside = np.zeros(len(body) + 2, np.int8)
    inside[1:-1] = kind[body]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(body))]
    cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]  # words meeting at a row's end
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def prefix_hashes(body: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes; spans are differences of it."""
    up, _ = powers(len(body) + 1)
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(BYTE_CODES[body] * up[: len(body)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A position-independent 64-bit hash of each span of bytes."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, read eight bytes at a time; for many short words."""
    length = ends - starts
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(body) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    some, at = slice(None), 0
    while at < 64:
        out[some] = mix(out[some] ^ (eights[starts[some] + at] & _LOW_BYTES[np.minimum(length[some] - at, 8)]))
        at += 8
        some = np.flatnonzero(length > at)
        if not len(some):
            return out
    for k in some.tolist():  # long runs without a blank
        out[k] = int.from_bytes(hashlib.blake2b(body[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of tokens[i : i + k] for every i <= len(tokens) - k."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = tokens[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += tokens[j : j + n]
    return mix(out)


def shingles(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, words per row): the k-word shingles; a shorter text is one shingle."""
    starts, ends, rows = words(body, offsets, kind)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    tokens = span_hashes(prefix_hashes(body), starts, ends)
    grams = gram_hashes(tokens, k)
    whole = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], rows[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = counts[short] > j
            extra[there] = (extra[there] + tokens[first[there] + j]) * np.uint64(0xD6E8FEB86659FD93)
            extra ^= extra >> np.uint64(31)
        grams, owner = np.concatenate([grams, mix(extra + np.uint64(k))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner, counts


def row_order(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by row and then hash.

    One sort of (row, upper bits of the hash); where these bits tie, the whole hashes are sorted.
    """
    if len(rows) and int(rows.max()) >= 1 << 24:
        return np.lexsort((hashes, rows))
    key = (rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    order = np.argsort(key)
    key = key[order]
    tied = key[1:] == key[:-1]
    unequal = tied & (hashes[order[1:]] != hashes[order[:-1]])
    if unequal.any():
        run = np.concatenate([[0], np.cumsum(~tied)])
        at = np.flatnonzero(np.isin(run, run[1:][unequal]))
        order[at] = order[at[np.lexsort((hashes[order[at]], run[at]))]]
    return order


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row), ordered by row and then hash."""
    order = row_order(hashes, rows)
    h, r = hashes[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], r[keep]


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, in one array."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(starts, lengths)
