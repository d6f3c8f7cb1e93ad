"""Vectorised byte, word and shingle hashing over batches of texts, shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: One random odd word for each byte value.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INV_BASE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
#: Bytes of ``[\x20\x09-\x0D]``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit affects every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _MIX[0]
    x ^= x >> U64(33)
    x *= _MIX[1]
    x ^= x >> U64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        _powers = np.full(size, _BASE)
        _inverse = np.full(size, _INV_BASE)
        _powers[0] = _inverse[0] = U64(1)
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverse, out=_inverse)
    return _powers, _inverse


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers data[:i]."""
    power, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], the same wherever the bytes stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives what has been freed back to the system: a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """The same function of batches, with a release of memory at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        release()

    return tidied


def portions(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that no more texts than these stand in memory as Python's bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    begin = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, a space after each, and where each begins (and the last ends)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begins[1:])
    return data, begins


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` in order, and the first word's index for each text (and the number of words)."""
    data, begins = joined(texts)
    data = LOWER[data]
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    hashes = span_hash(prefix_hash(data), start, end)
    return hashes, np.searchsorted(start, begins)


#: Odd factors of the places in a shingle.
_PLACE = _RNG.integers(1, 2**62, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; with fewer words the whole sequence as one; without words an empty set."""
    for a, b in blocks(texts):
        hashes, first = words(texts[a:b])
        count = len(hashes) - n + 1
        if count > 0:
            every = hashes[:count] * _PLACE[0]
            for k in range(1, n):
                every += hashes[k : k + count] * _PLACE[k]
            every = mix(every)
        for i in range(b - a):
            x, y = int(first[i]), int(first[i + 1])
            if y - x >= n:
                yield np.unique(every[x : y - n + 1])
            elif y > x:
                short = (hashes[x:y] * _PLACE[: y - x]).sum(dtype=U64) + U64(y - x)
                yield mix(np.array([short], U64))
            else:
                yield np.zeros(0, U64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, a place of each, and of each place the number's index. Which of equal numbers' places, is not told."""
    order = np.argsort(x)
    head = np.ones(len(x), bool)
    head[1:] = x[order[1:]] != x[order[:-1]]
    index = np.empty(len(x), np.int64)
    index[order] = np.cumsum(head) - 1
    first = order[head]
    return x[first], first, index


def ordered(x: np.ndarray) -> np.ndarray:
    """Places of numbers (U64) in order of the numbers: a plain sort, which is faster than one of places, of their upper bits with the places below them. Where upper bits are equal and the others differ, these few are sorted by the whole number."""
    n = len(x)
    bits = U64(max(n - 1, 1).bit_length())
    high = int(x.max(initial=0)).bit_length()
    if n < 256 or high <= 0:
        return np.argsort(x)
    key = x << U64(64 - high)
    key >>= bits
    key <<= bits
    key |= np.arange(n, dtype=U64)
    key.sort()
    order = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    if high + int(bits) > 64:
        held, key = x[order], key >> bits
        same = key[1:] == key[:-1]
        mixed = same & (held[1:] != held[:-1])
        if mixed.any():
            group = np.concatenate(([0], np.cumsum(~same)))
            bad = np.zeros(group[-1] + 1, bool)
            bad[group[1:][mixed]] = True
            some = np.flatnonzero(bad[group])
            order[some] = order[some][np.argsort(held[some])]
    return order


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``distinct`` gives of U64."""
    order = ordered(x)
    x = x[order]
    head = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=head[1:])
    index = np.empty(len(x), np.int64)
    index[order] = np.cumsum(head) - 1
    return x[head], order[head], index


def numbers(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, packed: the first bytes of all, then the second ones, and so on."""
    heads = np.array([len(c) for c in columns], "<u4").tobytes()
    return heads + zstandard.ZstdCompressor(level=1).compress(b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns))


def from_numbers(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u4", len(kinds)).tolist()
    body = zstandard.ZstdDecompressor().decompress(data[4 * len(kinds) :])
    out, at = [], 0
    for n, kind in zip(sizes, kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Numbers in order as differences, which pack well."""
    return np.diff(x, prepend=U64(0))
