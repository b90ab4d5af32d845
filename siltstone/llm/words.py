"""Words of whole texts and hashes of them, computed on a batch's bytes at once.

Words are maximal runs of characters other than space and U+0009 to U+000D; A to Z count as lower case.
Nulls count as empty texts. Hashes are 64-bit and depend on nothing but the words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but ASCII letters and digits and bytes of longer characters.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), so that all bits depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Powers by base, until a task ends.
powers_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, and made anew when a longer chunk comes."""
    if base not in powers_kept or len(powers_kept[base]) < n:
        x = np.full(max(n, CHUNK_BYTES + 1), base, U)
        x[0] = 1
        powers_kept[base] = np.cumprod(x, dtype=U)
    return powers_kept[base][:n]


def forget_powers() -> None:
    powers_kept.clear()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    x = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
    _, offsets, data = x.buffers()
    at = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(x) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(x) else np.zeros(1, np.int64)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi with their bytes and offsets, about `most` bytes at once; a longer text comes alone."""
    raw, at = flat(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def bounds(raw: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the n + 1 offsets of the texts among the words. apart: bytes in no word."""
    word = ~apart[raw]
    before, after = np.empty_like(word), np.empty_like(word)
    if len(raw):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
        edge = at[(at > 0) & (at < len(raw))]
        before[edge] = False
        after[edge - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A rolling polynomial over the lower-cased bytes, taken from its running sums, then mixed with the length."""
    n = len(raw)
    sums = np.zeros(n + 1, U)
    np.cumsum((LOWER[raw].astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word; the last k - 1 are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j, c in enumerate(powers(INVERSE, k + 1)[1:].tolist()):
        out += words[j : j + n] * U(c)
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, the sorted distinct shingle hashes of each row joined up, and the offsets of the rows.

    A text of fewer than k words has the whole sequence as its one shingle, one without words none."""
    for lo, hi, raw, at in chunks(texts):
        starts, ends, of = bounds(raw, at)
        w = word_hashes(raw, starts, ends)
        n = np.diff(of)
        g = np.zeros(len(w), U)
        full = grams(w, k)
        g[: len(full)] = full
        keep = np.zeros(len(w), bool)
        counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        row = np.repeat(np.arange(hi - lo), n)
        place = np.arange(len(w)) - of[:-1][row]
        keep = place < counts[row]
        c = powers(INVERSE, k + 1)[1:]
        for i in np.flatnonzero((n > 0) & (n < k)):
            a, b = of[i], of[i + 1]
            g[a] = mix(np.array([(w[a:b] * c[: b - a]).sum(dtype=U) + U(b - a)], U))[0]
        g = g[keep]
        edge = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(counts, out=edge[1:])
        for i in np.flatnonzero(counts > 1):
            g[edge[i] : edge[i + 1]].sort()
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        first[edge[:-1][counts > 0]] = True
        sums = np.zeros(len(g) + 1, np.int64)
        np.cumsum(first, out=sums[1:])
        yield lo, hi, g[first], sums[edge]


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum modulo 2 ** 64 of each stretch, 0 where it is empty."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
