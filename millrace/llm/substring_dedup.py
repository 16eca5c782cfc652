"""Operator 3, substring dedup by recompression.

Removes every word that a window of `width` consecutive words covers whose word sequence
also starts earlier (at a smaller doc_id, or earlier in the same document).

Recompression shortens the words of all documents round by round.  A round names maximal runs of one symbol,
then pairs of neighbours of which the first symbol's class is 0 and the second's is 1.  Names of these
rounds are hashes of what they stand for, so that equal content has equal names in every document before any
exchange; they only decide which windows meet.  Whether a symbol is formed depends only on the words between two
margins that are kept with it; symbols whose margins lie inside a window are therefore the same wherever
the window's words occur.

1. Each chunk of documents names symbols for `rounds` rounds.  `gram` neighbouring symbols of the last round are
   an anchor.  A window's key is its anchor of smallest hash.  (A window without one, as within a long run of one
   word, is its own key.)  Chunks send their distinct anchors, 8 bytes each, and a Spark round finds for the whole corpus
   which of them two chunks have.
2. Only a window whose key other chunks have too can lie in another chunk.  Runs of neighbouring windows of one such key go
   as text, with the document, to the key's part, each window once a chunk.
3. A part compares windows word by word and tells the chunks that don't hold the first occurrence.
   Keys of more than `hot` chunks aren't gathered in a part: their windows go as fingerprints of
   128 bits to parts of their own, so that no task gathers a hot passage.
4. Each chunk compares its own windows word by word, and removes the words.

So words decide, but for windows of hot keys, where two fingerprints of 64 bits must agree (among 10^13 windows a chance
of 10^-13 that any two unlike ones do).

Nulls and empty texts have no words and give n_words 0 and the hash of the empty string; an empty table gives no rows;
documents of fewer than `width` words lose nothing.  A very long text lies in one chunk and is worked on in one task.
Rows that repeat a doc_id are ordered by text, and equal rows as they come.  Rows without a doc_id count as before all others.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunk_count, chunked, part_count
from .suffixes import Suffixes
from .textbytes import U, buffer_of, inside, mix, release, rolling, space_split, split_by, strings, words_of

WIDTH, ROUNDS, GRAM, HOT = 20, 2, 3, 48
LOWEST = -(2**63)


def sorted_docs(table: pa.Table) -> pa.Table:
    """By doc_id, then text, so that a chunk's documents have one order on every run."""
    order = table["doc_id"].fill_null(LOWEST)
    return table.select(["doc_id", "text"]).append_column("order", order).sort_by([("order", "ascending"), ("text", "ascending")])


def level_0(name, doc_start, doc_end):
    """The words as symbols: names, margins (lo, hi: a symbol is settled by the words between them) and ends of documents."""
    at = np.arange(len(name))
    return name, at, at + 1, np.isin(at, doc_start), np.isin(at + 1, doc_end)


def fold_runs(name, lo, hi, opens, closes, first: bool):
    """Maximal runs of equal names as one symbol; it is settled once its neighbours are known.

    What opens or closes a document has no neighbour there, but may have one elsewhere: from the first round on its margin is
    the place outside the document, which no window holds."""
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | opens[1:]
    at = np.flatnonzero(head)
    end = np.append(at[1:], len(name)) - 1
    run = (end - at + 1).astype(U)
    out = np.where(run > 1, mix(name[at] + run * U(0x9E3779B97F4A7C15)), name[at])
    low = np.where(opens[at], lo[at] - first, lo[np.maximum(at - 1, 0)])
    high = np.where(closes[end], hi[end] + first, hi[np.minimum(end + 1, len(name) - 1)])
    return out, low, high, opens[at], closes[end]


def fold_pairs(name, lo, hi, opens, closes, salt):
    """One round of pairs; lo and hi are the word positions between which a symbol is settled."""
    kind = (mix(name ^ U(salt)) >> U(17)) & U(1) == 1
    pair = np.zeros(len(name), bool)
    pair[:-1] = ~kind[:-1] & kind[1:] & ~closes[:-1]
    second = np.zeros(len(name), bool)
    second[1:] = pair[:-1]
    at = np.flatnonzero(~second)
    nxt = np.minimum(at + 1, len(name) - 1)
    prv = np.maximum(at - 1, 0)
    p, k = pair[at], kind[at]
    out = np.where(p, mix(name[at] * U(0xA24BAED4963EE407) + name[nxt]), name[at])
    low = np.where(~p & k & ~opens[at], lo[prv], lo[at])
    high = np.where(p | (~k & ~closes[at]), hi[nxt], hi[at])
    return out, low, high, opens[at], np.where(p, closes[nxt], closes[at])


class Parsed:
    """Words, window starts and the anchor of each window, for one chunk."""

    def __init__(self, table: pa.Table, width: int):
        release()
        self.width = width
        self.docs = sorted_docs(table)
        self.ids = self.docs["order"].to_numpy()
        self.buf, off = buffer_of(self.docs["text"])
        self.starts, self.ends, self.words, self.first = words_of(self.buf, off, space_split())
        ok = inside(self.first, width, len(self.words))
        self.window = np.flatnonzero(ok)
        self.hash = rolling(self.words, width)[self.window]

    def second(self, of: np.ndarray) -> np.ndarray:
        """Second fingerprints of some windows."""
        return rolling(mix(self.words ^ U(0x632BE59BD9B4E019)), self.width, 0x9E3779B97F4A7C15)[self.window[of]]

    def again(self) -> np.ndarray:
        """Whether each window's words also start earlier in the chunk."""
        out = np.zeros(len(self.hash), bool)
        order = np.sort(self.hash)
        own = np.flatnonzero(is_in(self.hash, np.unique(order[1:][order[1:] == order[:-1]])))
        if len(own):
            at, new = exact(self.buf, self.starts, self.ends, self.words, self.window[own], self.hash[own], self.width)
            out[np.searchsorted(self.window, at[~new])] = True
        return out

    def anchors(self, rounds: int, gram: int):
        """The key of each window: the smallest hash of the anchors whose margins it holds."""
        key = self.hash ^ U(0x5DEECE66D)
        if not len(self.window):
            return key
        symbols = level_0(self.words, self.first[:-1], self.first[1:])
        for salt in range(rounds):
            symbols = fold_pairs(*fold_runs(*symbols, salt == 0), 0x1234567 + salt)
        name, lo, hi, _, _ = symbols
        n = len(name) - gram + 1
        if n <= 0:
            return key
        value, low, high = rolling(name, gram), lo[:n], hi[gram - 1 :]
        size = len(self.words) + 3
        from_ = np.cumsum(np.bincount(low + 1, minlength=size))  # at s: anchors settled from a word before s
        to = np.cumsum(np.bincount(high, minlength=size))
        w = self.window
        a, b = from_[w], to[w + self.width]
        # a sparse table for minima over the range a..b of anchors
        has = b > a
        span = np.where(has, b - a, 1)
        level = np.frexp(span)[1] - 1
        best = np.full(len(w), np.iinfo(np.uint64).max, U)
        table, step = value, 1
        for k in range(int(level.max()) + 1):
            pick = np.flatnonzero(has & (level == k))
            if len(pick):
                best[pick] = np.minimum(table[a[pick]], table[b[pick] - step])
            if len(table) <= step:
                break
            table = np.minimum(table[:-step], table[step:])
            step *= 2
        return np.where(has, best, key)


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words alone: hashes group them, and their bytes are compared."""
    _, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    like = at[number]
    ok = size == size[like]
    if ok.all():
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ok = buf[np.repeat(starts, size) + place] == buf[np.repeat(starts[like], size) + place]
    if not ok.all():
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(x, len(known)) for x in strings(buf, starts, ends)], np.int64)
    return number.astype(U)


def exact(buf, starts, ends, words, at, prints, width) -> tuple[np.ndarray, np.ndarray]:
    """The windows at word positions `at` with equal ones next to each other, and whether each begins a group."""
    marks = np.zeros(len(words), U)
    marks[at] = prints
    return Suffixes(word_numbers(buf, starts, ends, words), list(range(width)), marks).groups(at)


def ranges(first: np.ndarray, shift: np.ndarray, chunk: np.ndarray) -> list[tuple[int, bytes]]:
    """(chunk, triples of a run's first window, an offset and a length) of single windows that are sorted by run and offset."""
    new = np.ones(len(first), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (first[1:] != first[:-1]) | (shift[1:] != shift[:-1] + 1)
    head = np.flatnonzero(new)
    found = np.stack([first[head], shift[head], np.diff(np.append(head, len(first)))]).T.astype(np.int64)
    return [(int(c), found[chunk[head] == c].tobytes()) for c in np.unique(chunk[head])]


SEND = "part int, chunk int, kind int, keys binary, docs binary, sizes binary, bytes binary"
REPLY = "chunk int, kind int, keys binary"


def rows_of(rows) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.table({n.split()[0]: pa.array(list(c), k) for n, c, k in zip(SEND.split(", "), cols, kinds)})


def replies(chunk: np.ndarray, keys: np.ndarray, kind: int) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    got, at = np.unique(chunk[order], return_index=True)
    return pa.table({"chunk": pa.array(got, pa.int32()), "kind": pa.array([kind] * len(got), pa.int32()), "keys": pa.array([keys[x].tobytes() for x in np.split(order, at[1:])] if len(got) else [], pa.binary())})


def is_in(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which values are in the sorted pool; a bitmap of leading bits spares most searches."""
    out = np.zeros(len(values), bool)
    if not len(pool) or not len(values):
        return out
    if len(values) < 50_000:
        at = np.minimum(np.searchsorted(pool, values), len(pool) - 1)
        return pool[at] == values
    bits = U(64 - 23)
    table = np.zeros(1 << 23, bool)
    table[pool >> bits] = True
    maybe = np.flatnonzero(table[values >> bits])
    at = np.minimum(np.searchsorted(pool, values[maybe]), len(pool) - 1)
    out[maybe] = pool[at] == values[maybe]
    return out


def pool_of(table: pa.Table, kind: int) -> np.ndarray:
    rows = [k for k, x in zip(table["keys"].to_pylist(), table["kind"].to_pylist()) if x == kind]
    return np.unique(np.frombuffer(b"".join(rows), U))


def chunk_of(key) -> int:
    return key[0].as_py()


def shared_keys(table: pa.Table, hot: int) -> pa.Table:
    """Which of the chunks' keys other chunks have too: kind 0, or 2 if more than `hot` have them."""
    release()
    blobs = [np.frombuffer(x, U) for x in table["keys"].to_pylist()]
    keys, chunk = np.concatenate(blobs), np.repeat(table["chunk"].to_numpy(), [len(x) for x in blobs])
    order = np.argsort(keys, kind="stable")
    keys, chunk = keys[order], chunk[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(head, len(keys)))
    n = np.repeat(n, n)
    few, many = (n > 1) & (n <= hot), n > hot
    return pa.concat_tables([replies(chunk[few], keys[few], 0), replies(chunk[many], keys[many], 2)])


def substring_dedup(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text: kept words joined by one space), kept_sha256."""
    chunks = chunk_count(docs, chunk_bytes=chunk_bytes)
    parts = part_count(docs, chunks)
    rows = chunked(docs, chunks)

    def send_anchors(key, table):
        keys = np.unique(Parsed(table, width).anchors(rounds, gram))
        return rows_of([(p, chunk_of(key), 0, keys[x].tobytes(), b"", b"", b"") for p, x in (split_by(keys, parts) if len(keys) else [])])

    def send_windows(key, table, reply):
        parsed, out = Parsed(table, width), []
        keys, far = parsed.anchors(rounds, gram), ~parsed.again()
        few, many = pool_of(reply, 0), pool_of(reply, 2)
        doc = np.searchsorted(parsed.first, parsed.window, side="right") - 1
        loose = np.flatnonzero(far & is_in(keys, many))
        if len(loose):
            both = np.stack([parsed.hash[loose], parsed.second(loose), parsed.ids[doc[loose]].view(U), loose.astype(U)], axis=1)
            out += [(p, chunk_of(key), 1, both[x].tobytes(), b"", b"", b"") for p, x in split_by(both[:, 0], parts)]
        take = np.flatnonzero(far & is_in(keys, few))
        if len(take):
            new = np.ones(len(take), bool)
            new[1:] = (parsed.window[take][1:] != parsed.window[take][:-1] + 1) | (keys[take][1:] != keys[take][:-1])
            head = np.flatnonzero(new)
            last = take[np.append(head[1:], len(take)) - 1]
            head = take[head]
            texts = strings(parsed.buf, parsed.starts[parsed.window[head]], parsed.ends[parsed.window[last] + width - 1])
            sizes, ids = np.array([len(x) for x in texts], np.int64), parsed.ids[doc[head]]
            for p, x in split_by(keys[head], parts):
                out.append((p, chunk_of(key), 0, head[x].astype(np.int64).tobytes(), ids[x].tobytes(), sizes[x].tobytes(), b"".join([texts[i] for i in x.tolist()])))
        return rows_of(out)

    def later(key, table):
        """Which windows of a part aren't the first with their words."""
        release()
        kind, out = table["kind"].to_numpy(), []
        found = table.filter(pa.array(kind == 1))
        if len(found):
            both = np.frombuffer(b"".join(found["keys"].to_pylist()), U).reshape(-1, 4)
            chunk = np.repeat(found["chunk"].to_numpy(), [len(x) // 32 for x in found["keys"].to_pylist()])
            h, g, doc, place = both[:, 0], both[:, 1], both[:, 2].view(np.int64), both[:, 3].astype(np.int64)
            order = np.lexsort((chunk, doc, g, h))
            again = order[1:][(h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])]
            again = again[np.lexsort((place[again], chunk[again]))]
            # neighbouring windows as one range: each run begins at window 0
            out += ranges(np.zeros(len(again), np.int64), place[again], chunk[again])
        found = table.filter(pa.array(kind == 0))
        if len(found):
            sizes = [np.frombuffer(x, np.int64) for x in found["sizes"].to_pylist()]
            chunk = np.repeat(found["chunk"].to_numpy(), [len(x) for x in sizes])
            head, doc = (np.frombuffer(b"".join(found[c].to_pylist()), np.int64) for c in ("keys", "docs"))
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            buf = np.frombuffer(b"".join(found["bytes"].to_pylist()), np.uint8)
            starts, ends, words, first = words_of(buf, off, space_split())
            at = np.flatnonzero(inside(first, width, len(words)))
            at, new = exact(buf, starts, ends, words, at, rolling(words, width)[at], width)
            of = np.searchsorted(first, at, side="right") - 1
            group = np.cumsum(new)
            order = np.lexsort((chunk[of], doc[of], group))
            again = order[1:][group[order][1:] == group[order][:-1]]
            run, shift = of[again], at[again] - first[of[again]]
            order = np.lexsort((shift, head[run], chunk[run]))
            out += ranges(head[run][order], shift[order], chunk[run][order])
        cols = list(zip(*out)) if out else [[]] * 2
        return pa.table({"chunk": pa.array(list(cols[0]), pa.int32()), "kind": pa.array([1] * len(cols[0]), pa.int32()), "keys": pa.array(list(cols[1]), pa.binary())})

    def cut(key, table, reply):
        parsed = Parsed(table, width)
        hit = parsed.again()
        told = np.zeros(len(hit) + 1, np.int64)
        for x in reply["keys"].to_pylist():
            head, shift, n = np.frombuffer(x, np.int64).reshape(-1, 3).T
            np.add.at(told, head + shift, 1)
            np.add.at(told, head + shift + n, -1)
        hit |= np.cumsum(told)[:-1] > 0
        edge = np.zeros(len(parsed.words) + 1, np.int64)
        np.add.at(edge, parsed.window[hit], 1)
        np.add.at(edge, parsed.window[hit] + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        kept = np.flatnonzero(~gone)
        words = strings(parsed.buf, parsed.starts[kept], parsed.ends[kept])
        bounds = np.searchsorted(kept, parsed.first)
        texts = [b" ".join(words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        n = np.diff(parsed.first)
        return pa.table({
            "doc_id": parsed.docs["doc_id"],
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(total[parsed.first[1:]] - total[parsed.first[:-1]], pa.int64()),
            "kept": pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
        })

    by_chunk = rows.groupBy("chunk")
    anchors = by_chunk.applyInArrow(send_anchors, SEND)
    known = anchors.groupBy("part").applyInArrow(lambda key, table: shared_keys(table, hot), REPLY)
    windows = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send_windows, SEND)
    repeated = windows.groupBy("part").applyInArrow(later, REPLY)
    return by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op3_substring_dedup(spark, sf_dir) -> DataFrame:
    from .common import read

    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS i FROM win) WHERE i > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM again, range(20) r(j)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
