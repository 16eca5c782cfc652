"""Operator 5, exact byte dedup with a logarithmic family of suffix arrays.

Removes every byte that a string of `width` bytes covers which also starts anywhere else.

An IndexFamily (see suffixes) takes batch after batch: a batch's suffixes, each told by its first `width` bytes,
become a suffix array - the distinct ones in lexicographic order - which is merge-scanned against all levels;
equal suffixes are marked once their bytes have been compared.  Levels of like size are merged.

The corpus's suffixes are split over such families by key, so that each fits a task:

1. In each window the `gram`-byte string of smallest hash is the window's key.  Equal windows
   have equal keys, and neighbouring windows mostly share theirs, so that a chunk sends 8
   bytes for each of its distinct keys, about one in 50 bytes of text.
2. Chunks get those of their keys back that other chunks have too.
3. For such a key a chunk sends the bytes of its windows (runs of neighbouring windows as one
   string) to the key's part, once if it has them many times.  A key of more than `hot` chunks, as
   of a passage that very many documents share, isn't gathered in one part: its windows go as
   fingerprints of 128 bits to parts of their own.
4. A part feeds its chunks' suffixes to a family in batches of BATCH bytes; what is marked goes back to
   the chunks, as ranges or fingerprints.
5. Each chunk compares what it has twice in itself in the same way, and cuts the bytes.

So bytes decide, but for windows of hot keys, where two fingerprints of 64 bits, of the window and of its two halves, must agree
(among 10^14 windows a chance of 10^-11 that any two unlike ones do).  A part whose executor is lost builds its family anew
from the shuffled strings.

Null texts are empty; empty and short texts lose nothing, and an empty table gives no rows.  A very long text lies in one chunk, and is worked
on in one task.  Rows that repeat a doc_id are rows of their own, so that their equal texts remove each other.  A cut may fall inside a
character; `kept` is binary.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunk_count, chunked, part_count
from .substring_dedup import chunk_of, is_in, pool_of, shared_keys, sorted_docs
from .suffixes import IndexFamily, Suffixes, byte_loads, ordered
from .textbytes import U, buffer_of, byte_codes, inside, mix, powers, release, split_by

WIDTH, GRAM, HOT = 200, 100, 48
CHUNK_BYTES = 2 << 20
#: Bytes of suffixes that enter an index family at once.
BATCH = 4 << 20
SEND = "part int, chunk int, kind int, keys binary, sizes binary, bytes binary"
REPLY = "chunk int, kind int, keys binary"


BASE, AT_ONCE = 0x2545F4914F6CDD1D, 1 << 20


@cache
def base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    return powers(BASE, n), powers(pow(BASE, -1, 2**64), n)


def prints(buf: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """Fingerprints of all substrings of each width, as differences of running sums."""
    up, down = base_powers(AT_ONCE + max(widths))
    out = [np.zeros(max(0, len(buf) - w + 1), U) for w in widths]
    code = byte_codes(7)
    for s in range(0, len(buf), AT_ONCE):
        part = buf[s : s + AT_ONCE + max(widths) - 1]
        total = np.concatenate([np.zeros(1, U), np.cumsum(code[part] * up[: len(part)], dtype=U)])
        for x, w in zip(out, widths):
            n = min(AT_ONCE, len(part) - w + 1)
            if n > 0:
                x[s : s + n] = mix((total[w : w + n] - total[:n]) * down[:n])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def twice(h: np.ndarray) -> np.ndarray:
    """Which values are there twice."""
    order = np.sort(h)
    return is_in(h, np.unique(order[1:][order[1:] == order[:-1]]))


def pairs(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of fingerprints of 128 bits."""
    both = np.frombuffer(b"".join(rows), U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Windows:
    """The windows of a chunk: starts, fingerprints and keys."""

    def __init__(self, table: pa.Table, width: int, gram: int, full: bool = True):
        release()
        self.width, self.gram, self.docs = width, gram, sorted_docs(table)
        self.buf, self.off = buffer_of(self.docs["text"])
        self.at = np.flatnonzero(inside(self.off, width, len(self.buf)))
        if full:
            small, large = prints(self.buf, [gram, width])
            self.hash = large[self.at]
        else:
            small = prints(self.buf, [gram])[0]
        key = sliding_min(small, width - gram + 1)[self.at]
        self.small = small if full else None
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(self.at) != 1) | (key[1:] != key[:-1])
        #: Runs of neighbouring windows of one key: their first windows, lengths and keys.
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.append(self.head, len(key)))
        self.key = key[self.head]

    def second(self, of: np.ndarray) -> np.ndarray:
        """Second fingerprints of some windows, from those of their first and last `gram` bytes."""
        at = self.at[of]
        return mix(self.small[at] * U(0x9E3779B97F4A7C15) + self.small[at + self.width - self.gram])

    def runs(self, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last windows and keys of the runs whose key is in the pool."""
        i = np.flatnonzero(is_in(self.key, pool))
        return self.head[i], self.head[i] + self.size[i] - 1, self.key[i]


def rows_of(rows) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(["part", "chunk", "kind", "keys", "sizes", "bytes"], cols, kinds)})


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256."""
    chunks = chunk_count(docs, chunk_bytes=chunk_bytes)
    n_parts = part_count(docs, chunks)
    by_chunk = chunked(docs, chunks).groupBy("chunk")

    def send_keys(key, table):
        keys = np.unique(Windows(table, width, gram, full=False).key)
        return rows_of([(p, chunk_of(key), 0, keys[x].tobytes(), b"", b"") for p, x in (split_by(keys, n_parts) if len(keys) else [])])

    def send_suffixes(key, table, reply):
        w = Windows(table, width, gram)
        out = []
        loose = np.flatnonzero(np.repeat(is_in(w.key, pool_of(reply, 2)), w.size))
        if len(loose):
            both = np.stack([w.hash[loose], w.second(loose)], axis=1)[ordered(w.hash[loose])]
            both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])]
            out += [(p, chunk_of(key), 1, both[x].tobytes(), b"", b"") for p, x in split_by(both[:, 0], n_parts)]
        a, b, keys = w.runs(pool_of(reply, 0))
        if len(a):
            raw = w.buf.tobytes()
            parts: dict[int, dict] = {}
            part = ((keys >> U(32)) % U(n_parts)).astype(int)
            for i, (p, s, e) in enumerate(zip(part.tolist(), w.at[a].tolist(), (w.at[b] + width).tolist())):
                parts.setdefault(p, {}).setdefault(raw[s:e], i)
            for p, found in parts.items():
                out.append((p, chunk_of(key), 0, np.array(list(found.values()), np.int64).tobytes(), np.array([len(x) for x in found], np.int64).tobytes(), b"".join(found)))
        return rows_of(out)

    def scan(key, table):
        release()
        kind, out = table["kind"].to_numpy(), []
        rows = table.filter(pa.array(kind == 1)).select(["chunk", "keys"]).to_pylist()
        if rows:
            a, b = pairs([r["keys"] for r in rows])
            chunk = np.repeat([r["chunk"] for r in rows], [len(r["keys"]) // 16 for r in rows])
            order = np.lexsort((b, a))
            same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            shared = np.zeros(len(a), bool)
            shared[order[1:][same]] = shared[order[:-1][same]] = True
            i = np.flatnonzero(shared)
            out += [(int(c), 3, np.stack([a[i], b[i]], axis=1)[chunk[i] == c].tobytes()) for c in np.unique(chunk[i])]
        rows = table.filter(pa.array(kind == 0)).to_pylist()
        if rows:
            out += family_scan(rows)
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.table({"chunk": pa.array(list(cols[0]), pa.int32()), "kind": pa.array(list(cols[1]), pa.int32()), "keys": pa.array(list(cols[2]), pa.binary())})

    def family_scan(rows):
        """Through one family, in batches of BATCH bytes; ranges of marked windows by chunk."""
        rows.sort(key=lambda r: r["chunk"])
        sizes = [np.frombuffer(r["sizes"], np.int64) for r in rows]
        off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        chunk = np.repeat([r["chunk"] for r in rows], [len(x) for x in sizes])
        run = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
        buf = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        rows.clear()
        codes, offsets = byte_loads(buf, width)
        marks = np.zeros(len(buf), U)
        family = IndexFamily(Suffixes(codes, offsets, marks))
        edges = np.unique(np.searchsorted(off, np.arange(0, len(buf), BATCH)))
        every = []
        for i, j in zip(edges, [*edges[1:], len(off) - 1]):
            some = off[i : j + 1] - off[i]
            part = buf[off[i] : off[j]]
            at = np.flatnonzero(inside(some, width, len(part)))
            marks[off[i] + at] = prints(part, [width])[0][at]
            every.append(off[i] + at)
            family.add(every[-1])
        at = np.concatenate(every)
        at = at[family.shared[at]]
        if not len(at):
            return []
        of = np.searchsorted(off, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (of[1:] != of[:-1])
        head = np.flatnonzero(new)
        found = np.stack([run[of[head]], at[head] - off[of[head]], np.diff(np.append(head, len(at)))]).T.astype(np.int64)
        by = chunk[of[head]]
        return [(int(c), 1, found[by == c].tobytes()) for c in np.unique(by)]

    def cut(key, table, reply):
        w = Windows(table, width, gram)
        hit = np.zeros(len(w.at), bool)
        own = np.flatnonzero(twice(w.hash))
        if len(own):
            codes, offsets = byte_loads(w.buf, width)
            marks = np.zeros(len(w.buf), U)
            marks[w.at[own]] = w.hash[own]
            family = IndexFamily(Suffixes(codes, offsets, marks))
            family.distinct(w.at[own])
            hit[own] = family.shared[w.at[own]]
            del codes, marks, family
        loose = [x for k, x in zip(reply["kind"].to_pylist(), reply["keys"].to_pylist()) if k == 3]
        if loose:
            a, b = pairs(loose)
            some = np.flatnonzero(is_in(w.hash, np.unique(a)))
            hit[some] |= is_in(mix(w.hash[some]) + w.second(some), np.unique(mix(a) + b))
        a, _, _ = w.runs(pool_of(reply, 0))
        edge = np.zeros(len(w.at) + 1, np.int64)
        for k, blob in zip(reply["kind"].to_pylist(), reply["keys"].to_pylist()):
            if k == 1:
                run, shift, size = np.frombuffer(blob, np.int64).reshape(-1, 3).T
                np.add.at(edge, a[run] + shift, 1)
                np.add.at(edge, a[run] + shift + size, -1)
        hit |= np.cumsum(edge)[:-1] > 0
        cover = np.zeros(len(w.buf) + 1, np.int32)
        cover[w.at[hit]] += 1
        cover[w.at[hit] + width] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        cut_ = w.off[(w.off > 0) & (w.off < len(w.buf))]
        opens[cut_] |= gone[cut_]
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
        kept, raw = [], w.buf
        for s, e in zip(w.off[:-1].tolist(), w.off[1:].tolist()):
            kept.append(raw[s:e][~gone[s:e]].tobytes() if total[e] > total[s] else raw[s:e].tobytes())
        return pa.table({
            "doc_id": w.docs["doc_id"],
            "n_bytes": pa.array(np.diff(w.off), pa.int64()),
            "n_removed": pa.array(total[w.off[1:]] - total[w.off[:-1]], pa.int64()),
            "n_spans": pa.array(spans[w.off[1:]] - spans[w.off[:-1]], pa.int64()),
            "kept": pa.array(kept, pa.binary()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        })

    known = by_chunk.applyInArrow(send_keys, SEND).groupBy("part").applyInArrow(lambda key, table: shared_keys(table, hot), REPLY)
    suffixes = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send_suffixes, SEND)
    found = suffixes.groupBy("part").applyInArrow(scan, REPLY).union(known)
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op5_suffix_dedup(spark, sf_dir) -> DataFrame:
    from .common import read

    return suffix_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
