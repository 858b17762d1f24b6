"""Vector operations on columns of text: whole Arrow batches at once, no Python object per word.

All functions take a string array (nulls count as empty texts) and return flat arrays with row offsets.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Fixed value: the code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by Unicode general category. No letter or number lies beyond plane 3."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    cats = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x34000)).encode(), np.uint8)
    table[:0x34000][cats == ord("L")] = LETTER
    table[:0x34000][cats == ord("N")] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


@functools.cache
def lower_map() -> np.ndarray:
    """The lower-case form of every code point that has one of a single code point, else itself."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(0x20000):  # no cased letter lies beyond plane 1
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finalizer)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(arr: pa.Array, max_bytes: int = 1 << 20):
    """(first row, part) of an array in parts of about ``max_bytes``, so that work fits the caches; a longer row stands alone."""
    if not len(arr):
        return
    size = pc.binary_length(arr.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // max_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(arr)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(a), arr.slice(a, b - a)


def raw(arr: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all rows, one after the other, and row offsets into them. Invalid bytes become U+FFFD."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return b"", np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    body = memoryview(data)[off[0] : off[-1]].tobytes() if data is not None else b""
    off = off - off[0]
    try:
        body.decode("utf-8")
    except UnicodeDecodeError:
        rows = [body[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(off[:-1], off[1:])]
        body, off = b"".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return body, off


def codepoints(body: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte offset of each (one more at the end), and row offsets in code points."""
    cp = np.frombuffer(body.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = np.ones(len(cp), np.int64)
    width += cp > 0x7F
    width += cp > 0x7FF
    width += cp > 0xFFFF
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    return cp, at, np.searchsorted(at, off)


def bpe_words(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the byte-level BPE pattern: a flat string array and row offsets into it.

    A run of letters, of numbers or of other characters is a word, with one blank before it if there is one; the
    English contractions 's 't 're 've 'm 'll 'd are words where a word starts at the apostrophe; of a run of white
    space before something else, the last character stands apart, and joins the next word if it is a blank.
    """
    body, off = raw(arr)
    if not body:
        return pa.array([], pa.string()), np.zeros(len(off), np.int64)
    cp, at, row = codepoints(body, off)
    n, kind = len(cp), classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[row] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    rs = np.flatnonzero(begins)
    re_ = np.append(rs[1:], n)
    rk, ends_row = kind[rs], edge[re_]
    word = np.zeros(n + 1, bool)
    word[n] = True
    space = rk == SPACE
    word[rs[space]] = True
    word[re_[space & ~ends_row] - 1] = True
    solid = ~space
    after_blank = np.zeros(len(rs), bool)
    after_blank[1:] = (cp[rs[1:] - 1] == 32) & ~edge[rs[1:]]
    word[rs[solid & ~after_blank]] = True
    quote = np.flatnonzero(solid & ~after_blank & (re_ - rs == 1) & (cp[rs] == 39) & ~ends_row)
    if len(quote):
        nxt = quote + 1
        letters = rk[nxt] == LETTER
        nxt = nxt[letters]
        a, b, size = cp[rs[nxt]], cp[np.minimum(rs[nxt] + 1, n - 1)], re_[nxt] - rs[nxt]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (size >= 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        took = np.where(one, 1, np.where(two, 2, 0))
        hit = took > 0
        word[rs[nxt[hit]]] = False
        rest = hit & (size > took)
        word[rs[nxt[rest]] + took[rest]] = True
    cuts = np.flatnonzero(word)
    big = at[-1] >= 2**31 - 1
    flat = pa.Array.from_buffers(
        pa.large_string() if big else pa.string(), len(cuts) - 1, [None, pa.py_buffer(at[cuts].astype(np.int64 if big else np.int32).tobytes()), pa.py_buffer(body)]
    )
    return flat, np.searchsorted(cuts, row)


def _runs_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run of values, by prefix sums."""
    n = len(values)
    power = np.empty(n + 1, U64)
    inverse = np.empty(n + 1, U64)
    power[0] = inverse[0] = 1
    power[1:], inverse[1:] = _BASE, _BASE_INV
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(U64))


def windows_hash(values: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The Karp-Rabin hash of the window of ``size`` values at each start."""
    return _runs_hash(mix(values), start, start + size) if len(start) else np.empty(0, U64)


@functools.cache
def _ascii_words() -> tuple[np.ndarray, np.ndarray]:
    inside, low = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
        inside[c] = True
    low[65:91] += 32
    return inside, low


def word_hashes(arr: pa.Array, unicode_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word and row offsets.

    Words are maximal runs of letters and digits of any script, or else of A-Z, a-z, 0-9 and ``_``.
    """
    body, off = raw(arr)
    if not body:
        return np.empty(0, U64), np.zeros(len(off), np.int64)
    if unicode_words:
        cp, _, row = codepoints(body, off)
        kind = classes()[cp]
        inside, value = (kind == LETTER) | (kind == NUMBER), lower_map()[cp]
    else:
        b = np.frombuffer(body, np.uint8)
        table, low = _ascii_words()
        inside, value, row = table[b], low[b], off
    n = len(inside)
    step = np.zeros(n + 1, bool)
    step[row] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | step[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | step[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return _runs_hash(mix(value.astype(U64) + U64(1)), s, e), np.searchsorted(s, row)


def row_ids(off: np.ndarray) -> np.ndarray:
    """The row of each flat value."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
