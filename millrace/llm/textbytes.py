"""Vectorised word and window hashing over Arrow string columns.

A batch of texts is one byte buffer with document offsets; words are runs of bytes
that a 256-entry table marks as word bytes.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = [0x20, *range(0x09, 0x0E)]


def space_split() -> np.ndarray:
    """Word bytes: everything but space and the controls 09 to 0D."""
    lut = np.ones(256, bool)
    lut[SPACE] = False
    return lut


def alnum_split() -> np.ndarray:
    """Word bytes: 0-9, a-z and every byte of a non-ASCII character."""
    lut = np.zeros(256, bool)
    lut[0x30:0x3A] = lut[0x61:0x7B] = lut[0x80:] = True
    return lut


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def release() -> None:
    """Gives memory of earlier batches back to the system: workers live long, and what they only hold counts too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have no such call
    if trim is not None:
        trim(0)


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; the bytes of null rows are cut out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words_of(buf: np.ndarray, off: np.ndarray, lut: np.ndarray, seed: int = 1):
    """(starts, ends, hashes, first): byte ranges and 64-bit hashes of all words; document d has
    the words first[d]:first[d+1].  A word never crosses a document's end."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), np.zeros(len(off), np.int64)
    isw = lut[buf]
    start = isw.copy()
    start[1:] &= ~isw[:-1]
    cut = off[(off > 0) & (off < n)]
    start[cut] |= isw[cut]
    starts = np.flatnonzero(start)
    end = isw.copy()
    end[:-1] &= ~isw[1:] | start[1:]
    ends = np.flatnonzero(end) + 1
    first = np.searchsorted(starts, off)
    if not len(starts):
        return starts, ends, np.zeros(0, U), first
    lens = ends - starts
    at = np.cumsum(lens) - lens
    where = np.flatnonzero(isw)
    place = np.arange(len(where)) - np.repeat(at, lens)
    value = byte_codes(seed)[buf[where]] * powers(0x5851F42D4C957F2D, int(lens.max()))[place]
    return starts, ends, mix(np.add.reduceat(value, at) + lens.astype(U)), first


def rolling(h: np.ndarray, width: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values (by doubling); shorter at the end: none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, power, size, rest = None, 0, h, 1, width
    b = base
    while rest:
        if rest & 1:
            out = power if out is None else out[: len(power) - done] * U(b) + power[done:]
            done += size
        rest >>= 1
        if rest:
            power = power[: len(power) - size] * U(b) + power[size:]
            b = (b * b) & (2**64 - 1)
            size *= 2
    return mix(out[:n])


def inside(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """For each start in 0..total-width: does the run stay within its document?"""
    n = max(0, total - width + 1)
    ok = np.ones(n, bool)
    for shift_end in first[1:-1]:
        ok[max(0, shift_end - width + 1) : min(n, shift_end)] = False
    return ok


def split_by(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, indexes) of keys by their high bits."""
    part = ((keys >> U(32)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    got, at = np.unique(part[order], return_index=True)
    return [(int(p), x) for p, x in zip(got, np.split(order, at[1:]))]


def strings(raw: bytes | np.ndarray, starts, ends) -> list[bytes]:
    raw = bytes(raw)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
