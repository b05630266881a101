"""Exact substring dedup over suffix arrays.

A byte is removed when it lies in a string of `length` bytes that also starts in a document with a smaller doc_id.

Plan: equal windows of `length` bytes contain the same minimal k-gram at the same place, so each window belongs to the
bucket of its minimal k-gram's hash; consecutive windows with one minimum travel as one short segment. Documents are
dealt to chunks once, and every later step reuses that exchange:
1. each chunk lists the hashes of its minimal k-grams, and each bucket answers which of them occur elsewhere too;
2. each chunk sends the segments of shared k-grams to their buckets, less the windows that its own blocks mark;
3. each bucket marks the windows that a smaller document has, and deals the marks back to the chunks. A k-gram of more
   than `wide` chunks meets twice: first in one bucket for every `wide` chunks, which keep the smallest document's
   windows, then those in its own bucket, so that a passage of all chunks is shared out too.
A block of segments is marked by a suffix array built in two stages: only suffixes smaller than their successors are
sorted directly, the others are induced by one scan over the 256 first-byte buckets. Adjacent common prefixes then
give the groups of equal windows, and all of a group but the smallest document's are marked. The pass in step 2 is a
combiner: a passage in a third of all documents sends one copy per block, and its k-grams one hash per chunk.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions

LENGTH, GRAM = 50, 20
BLOCK_BYTES, SHARE_BYTES, HASH_BYTES = 4 << 20, 1 << 19, 1 << 18
CHUNK_BYTES = 64 << 20
WIDE = 32
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3


def _packed(t: np.ndarray) -> np.ndarray:
    """Big-endian words of the 8 bytes from each position; t is padded by 8 bytes at least."""
    w = t.astype(np.uint64)
    for half in (1, 2, 4):
        w = (w[:-half] << np.uint64(8 * half)) | w[half:]
    return w


def _direct_sort(pos: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their first `depth` bytes: sorted by one word, then only ties by the next."""
    key = words[pos]
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(pos) else np.zeros(0, np.int64)
    for j in range(8, depth, 8):
        size = np.bincount(group)
        open_at = np.flatnonzero(size[group] > 1)
        if not len(open_at):
            break
        sub, g = pos[open_at], group[open_at]
        key = words[sub + j]
        order = np.lexsort((key, g))
        sub, g, key = sub[order], g[order], key[order]
        pos[open_at] = sub
        new = np.zeros(len(pos), bool)
        new[open_at[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | new[1:])))
    return pos


def suffix_array(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes of the bytes t in the order of their first `depth` bytes, by two-stage sorting.

    wanted is a mask. A suffix larger than its successor is induced from it, so the chain up to the next smaller-than-
    successor suffix is sorted too.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    words = _packed(np.concatenate([t, np.zeros(depth + 16, np.uint8)]))
    change = np.flatnonzero(np.concatenate([t[:-1] != t[1:], [True]]))
    rising = np.concatenate([t[change[:-1]] < t[change[:-1] + 1], [False]])  # of each run of one byte
    small = np.repeat(rising, np.diff(np.concatenate([[-1], change])))
    small[n - 1] = False
    need = wanted.copy()
    new = np.flatnonzero(need & ~small)
    while len(new := new[new < n - 1] + 1):
        new = new[~need[new]]
        need[new] = True
        new = new[~small[new]]
    start = np.flatnonzero(need & small)
    direct = _direct_sort(start, words, depth)
    first = t[direct]
    bound = np.searchsorted(first, np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[n - 1]:
        larger[t[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(cur: np.ndarray, c: int) -> np.ndarray:
        p = cur[cur > 0] - 1
        p = p[need[p] & ~small[p]]
        b = t[p]
        same, rest = p[b == c], p[b != c]
        if len(rest):
            b = t[rest]
            order = np.argsort(b, kind="stable")
            rest, b = rest[order], b[order]
            cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
            for part in np.split(rest, cuts):
                larger[t[part[0]]].append(part)
        return same

    for c in range(256):
        cur = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        larger[c] = []
        while len(cur):
            out.append(cur)
            cur = induce(cur, c)
        part = direct[bound[c] : bound[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    sa = np.concatenate(out) if out else np.zeros(0, np.int64)
    return sa[wanted[sa]]


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix of sa shares with the one before it, up to cap; 0 for the first."""
    words = _packed(np.concatenate([t, np.zeros(cap + 16, np.uint8)]))
    out = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    for j in range(0, cap, 8):
        x = words[sa[live] + j] ^ words[sa[live - 1] + j]
        whole = x == 0
        part = x[~whole]
        same = np.zeros(len(part), np.int64)
        for s in (56, 48, 40, 32, 24, 16, 8):
            same += (part >> np.uint64(s)) == 0
        out[live[~whole]] = j + same
        live = live[whole]
    out[live] = cap
    return np.minimum(out, cap)


class Segments:
    """Runs of windows that share their minimal k-gram: document index, first window, number of windows, bytes, place of the k-gram."""

    def __init__(self, ids, keys, doc, start, runs, data, gram_at, grams):
        self.ids, self.keys, self.doc, self.start, self.runs, self.data, self.gram_at, self.grams = ids, keys, doc, start, runs, data, gram_at, grams

    def __len__(self) -> int:
        return len(self.doc)

    def offsets(self, length: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.runs.astype(np.int64) + length - 1)])

    def take(self, pick: np.ndarray, length: int) -> Segments:
        off = self.offsets(length)
        at = _ranges(off[:-1][pick], np.diff(off)[pick])
        return Segments(self.ids, self.keys, self.doc[pick], self.start[pick], self.runs[pick], self.data[at], self.gram_at[pick], self.grams[pick])

    def pack(self) -> bytes:
        used, doc = np.unique(self.doc, return_inverse=True)
        parts = [self.ids[used].astype("<i8"), self.keys[used].astype("<i8"), doc.astype("<u4"), self.start.astype("<i8"), self.runs.astype("u1"), self.gram_at.astype("u1"), self.data]
        return zstandard.compress(struct.pack("<7q", *(x.nbytes for x in parts)) + b"".join(x.tobytes() for x in parts), 3)

    @staticmethod
    def unpack(blobs: list[bytes], length: int, k: int) -> tuple[Segments, list[int]]:
        """The segments, and the number of documents of each blob."""
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        base = 0
        for blob in blobs:
            raw = zstandard.decompress(blob)
            sizes = struct.unpack_from("<7q", raw)
            at = 56
            for i, (size, kind) in enumerate(zip(sizes, ("<i8", "<i8", "<u4", "<i8", "u1", "u1", "u1"), strict=True)):
                x = np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at)
                cols[i].append(x.astype(np.int64) + base if i == 2 else x)
                at += size
            base += len(cols[0][-1])
        ids, keys, doc, start, runs, gram_at, data = (np.concatenate(x) for x in cols)
        off = np.concatenate([[0], np.cumsum(runs.astype(np.int64) + length - 1)])[:-1] + gram_at
        h = np.zeros(len(doc), np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + data[off + j]
        return Segments(ids, keys, doc, start, runs, data, gram_at, _mixed(h)), [len(x) for x in cols[0]]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] values, then those of first[1], and so on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def segments(ids: np.ndarray, keys: np.ndarray, pieces: list[tuple[int, int, bytes]], length: int, k: int, shared: np.ndarray | None = None, with_data: bool = True) -> Segments:
    """Segments of the pieces (document index, place of the first byte, bytes), hashed in stretches that the cache holds; shared: only of those k-grams (sorted)."""
    got, part, held = [], [], 0
    for doc, first, raw in pieces:
        for at in range(0, max(1, len(raw) - length + 1), HASH_BYTES):
            part.append((doc, first + at, raw[at : at + HASH_BYTES + length - 1]))
            held += len(part[-1][2])
            if held >= HASH_BYTES:
                got.append(_segments(ids, keys, part, length, k, shared, with_data))
                part, held = [], 0
    if part or not got:
        got.append(_segments(ids, keys, part, length, k, shared, with_data))
    return _together(got)


def _together(got: list[Segments]) -> Segments:
    return Segments(got[0].ids, got[0].keys, *(np.concatenate([getattr(x, c) for x in got]) for c in ("doc", "start", "runs", "data", "gram_at", "grams")))


def _segments(ids: np.ndarray, keys: np.ndarray, pieces: list[tuple[int, int, bytes]], length: int, k: int, shared: np.ndarray | None = None, with_data: bool = True) -> Segments:
    pieces = [p for p in pieces if len(p[2]) >= length]
    empty = np.zeros(0, np.int64)
    if not pieces:
        return Segments(ids, keys, empty, empty, empty, np.zeros(0, np.uint8), empty, np.zeros(0, np.uint64))
    t = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    # polynomial hash of each k-gram, by doubling
    h, have, acc, acc_len, bit = t.astype(np.uint64), 1, None, 0, k
    while True:
        if bit & 1:
            if acc is None:
                acc, acc_len = h, have
            else:
                m = len(t) - (acc_len + have) + 1
                acc = h[:m] * np.uint64(pow(_BASE, acc_len, 1 << 64)) + acc[have : have + m]
                acc_len += have
        bit >>= 1
        if not bit:
            break
        m = len(t) - 2 * have + 1
        h = h[:m] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have : have + m]
        have *= 2
    acc = _mixed(acc)
    v = (acc & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(acc), dtype=np.uint64)
    del h
    w, have = length - k + 1, 1
    while 2 * have <= w:
        v, have = np.minimum(v[:-have], v[have:]), 2 * have
    if have < w:
        v = np.minimum(v[: len(v) - (w - have)], v[w - have :])
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the minimal k-gram of the window from each place
    del v
    inside = np.ones(len(at), bool)
    for e in ends[:-1]:
        inside[max(0, e - length + 1) : e] = False
    head = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]))
    places = np.flatnonzero(inside)
    runs = np.diff(np.concatenate([np.searchsorted(places, head), [len(places)]]))
    piece = np.searchsorted(ends, head, side="right")
    begin = np.concatenate([[0], ends[:-1]])
    doc = np.array([p[0] for p in pieces], np.int64)[piece]
    start = head - begin[piece] + np.array([p[1] for p in pieces], np.int64)[piece]
    if shared is not None:
        g = acc[at[head]] >> np.uint64(_DROP)
        pick = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, g), len(shared) - 1)] == g)
        head, runs, doc, start = head[pick], runs[pick], doc[pick], start[pick]
    data = t[_ranges(head, runs + length - 1)] if with_data else np.zeros(0, np.uint8)
    return Segments(ids, keys, doc, start, runs, data, at[head] - head, acc[at[head]])


def mark_all(s: Segments, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
    """mark() over shares of the k-grams, so small that a share's arrays stay in the processor's cache."""
    n = len(s.data) // SHARE_BYTES
    if n < 2:
        return mark(s, length)
    got = [mark(s.take(part, length), length) for _, part in _split(((s.grams >> np.uint64(_DROP + 20)) % np.uint64(n)).astype(np.int64))]
    doc, first, end = (np.concatenate([g[i] for g in got]) for i in range(3))
    return doc, first, end, _together([g[3] for g in got])


def mark(s: Segments, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
    """Windows that a smaller document of the block has too, as runs (document index, first window, end), and what is left."""
    none = np.zeros(0, np.int64)
    if not len(s):
        return none, none, none, s
    order = np.argsort(s.grams, kind="stable")
    g, owner = s.grams[order], s.ids[s.doc[order]]
    cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    shared = np.minimum.reduceat(owner, cuts) != np.maximum.reduceat(owner, cuts)
    both = np.zeros(len(s), bool)
    both[order[np.repeat(shared, np.diff(np.concatenate([cuts, [len(g)]])))]] = True
    if not both.any():
        return none, none, none, s
    c = s.take(np.flatnonzero(both), length)
    off = c.offsets(length)
    runs = c.runs.astype(np.int64)
    place = _ranges(off[:-1], runs)
    wanted = np.zeros(len(c.data), bool)
    wanted[place] = True
    sa = suffix_array(c.data, wanted, length)
    new = common_prefixes(c.data, sa, length) < length
    seg_of = np.repeat(np.arange(len(c)), runs)
    window_at = np.full(len(c.data), -1, np.int64)
    window_at[place] = np.arange(len(place))
    ids = c.ids[c.doc[seg_of[window_at[sa]]]]
    cuts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids, cuts), np.diff(np.concatenate([cuts, [len(sa)]])))
    dup = np.zeros(len(place), bool)
    dup[window_at[sa[ids > least]]] = True
    # runs of one verdict within each segment
    edge = np.flatnonzero(np.concatenate([[True], (dup[1:] != dup[:-1]) | (seg_of[1:] != seg_of[:-1])]))
    seg, size, verdict = seg_of[edge], np.diff(np.concatenate([edge, [len(dup)]])), dup[edge]
    inner = edge - np.concatenate([[0], np.cumsum(runs)[:-1]])[seg]
    first = c.start[seg] + inner
    bad, ok = verdict, ~verdict
    src_at = off[:-1][seg[ok]] + inner[ok]
    src = _ranges(src_at, size[ok] + length - 1)
    rest = s.take(np.flatnonzero(~both), length)
    left = Segments(
        s.ids, s.keys, np.concatenate([rest.doc, c.doc[seg[ok]]]), np.concatenate([rest.start, first[ok]]), np.concatenate([rest.runs, size[ok]]),
        np.concatenate([rest.data, c.data[src]]), np.concatenate([rest.gram_at, c.gram_at[seg[ok]].astype(np.int64) - inner[ok]]), np.concatenate([rest.grams, c.grams[seg[ok]]]),
    )
    return c.doc[seg[bad]], first[bad], first[bad] + size[bad], left


_KEYS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
_LAST, _MARKS, _FIRST = 0, 1, 2  #: Kinds of rows: segments in the bucket of their k-gram, marks of a chunk, segments of wide k-grams before.
_DROP = 16  #: Low bits of a k-gram's hash that are left out when only its presence is asked; a chance meeting costs time alone.


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[] for _ in schema], schema.types, strict=True)], schema=schema)


def _raw(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes()


def _blocks(docs: pa.Table, length: int, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """ids, row keys and pieces of the documents, in blocks of about block_bytes; longer texts are cut, overlapping by length - 1."""
    ids, keys = (np.array(docs.column(c).to_numpy(), np.int64) for c in ("doc_id", "row_key"))
    pieces, held = [], 0
    for i, text in enumerate(docs.column("text").cast(pa.binary())):
        raw = _raw(text)
        for at in range(0, max(0, len(raw) - length + 1), block_bytes):
            pieces.append((i, at, raw[at : at + block_bytes + length - 1]))
            held += len(pieces[-1][2])
            if held >= block_bytes:
                yield ids, keys, pieces
                pieces, held = [], 0
    if pieces:
        yield ids, keys, pieces


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(bucket[order][1:] != bucket[order][:-1]) + 1):
            yield int(bucket[part[0]]), part


def _list_grams(length: int, k: int, parts: int, block_bytes: int):
    """Of a chunk, the hashes of its minimal k-grams: twice where two of its blocks, or two documents of one, have one."""

    def of(block) -> Iterator[np.ndarray]:
        s = segments(*block, length, k, with_data=False)
        if len(s):
            order = np.argsort(s.grams, kind="stable")
            g, doc = s.grams[order] >> np.uint64(_DROP), s.doc[order]
            cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            yield g[cuts]
            yield g[cuts[np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts)]]

    def run(docs: pa.Table) -> pa.Table:
        chunk = docs.column("chunk")[0].as_py()
        got = [g for block in _blocks(docs, length, block_bytes) for g in of(block)]
        grams = np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)
        grams = grams[np.concatenate([[True, True], grams[2:] != grams[:-2]])[: len(grams)]]
        bucket = (grams % np.uint64(parts)).astype(np.int64)
        rows = []
        for b, part in _split(bucket):
            g = grams[part]
            rows.append((b, chunk, zstandard.compress(np.diff(g // np.uint64(parts), prepend=np.uint64(0)).astype("<u8").view("u1").reshape(-1, 8).T.tobytes(), 3)))
        return _rows(_KEYS, rows)

    return run


def _grams(blob: bytes, bucket: int, parts: int) -> np.ndarray:
    delta = np.frombuffer(zstandard.decompress(blob), "u1").reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(delta, dtype=np.uint64) * np.uint64(parts) + np.uint64(bucket)


def _find_shared(parts: int, most: int):
    """Of a bucket, which k-grams of each chunk another chunk or block has too; the last bit tells those of more than `most` chunks."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        chunks = group.column("chunk").to_pylist()
        grams = [_grams(_raw(b), bucket, parts) for b in group.column("blob")]
        every = np.sort(np.concatenate(grams))
        both = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        grams = [np.unique(g[np.isin(g, both)]) for g in grams]
        value, times = np.unique(np.concatenate(grams), return_counts=True)
        wide = value[times > most]
        rows = []
        for chunk, g in zip(chunks, grams, strict=True):
            if len(g):
                g = (g << np.uint64(1)) | np.isin(g, wide).astype(np.uint64)
                rows.append((bucket, chunk, zstandard.compress(g.astype("<u8").tobytes(), 3)))
        return _rows(_KEYS, rows)

    return run


def _send(length: int, k: int, parts: int, block_bytes: int, most: int):
    """Of a chunk, the segments of shared k-grams, less what a block's own suffix array has marked."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _rows(_SENT, [])
        chunk = docs.column("chunk")[0].as_py()
        shared = np.sort(np.concatenate([np.frombuffer(zstandard.decompress(_raw(b)), "<u8") for b in told.column("blob")]))
        wide = shared[shared & np.uint64(1) == 1] >> np.uint64(1)
        shared = shared >> np.uint64(1)
        rows, held = [], []
        for block in _blocks(docs, length, block_bytes):
            doc, s, e, left = mark_all(segments(*block, length, k, shared), length)
            if len(doc):
                held.append(np.stack([block[0][doc], block[1][doc], s, e]))
            bucket, hot = _bucket(left, parts), np.isin(left.grams >> np.uint64(_DROP), wide)
            for kind, pick, shift in ((_LAST, np.flatnonzero(~hot), 0), (_FIRST, np.flatnonzero(hot), 1 + chunk // most)):
                for b, part in _split((bucket[pick] + shift) % parts):
                    rows.append((b, chunk, kind, left.take(pick[part], length).pack()))
        if held:
            rows.append((chunk, chunk, _MARKS, zstandard.compress(np.concatenate(held, axis=1).astype("<i8").tobytes(), 3)))
        return _rows(_SENT, rows)

    return run


def _bucket(s: Segments, parts: int) -> np.ndarray:
    return ((s.grams >> np.uint64(_DROP)) % np.uint64(parts)).astype(np.int64)


def _meet(length: int, k: int, parts: int):
    """Of a bucket, the runs of windows that a smaller document has too, dealt to their chunks; what is left of wide k-grams goes on to their own buckets."""

    def run(group: pa.Table) -> pa.Table:
        rows = []
        sent: dict[int, list[tuple[int, bytes]]] = {_LAST: [], _FIRST: []}
        for chunk, kind, blob in zip(group.column("chunk").to_pylist(), group.column("kind").to_pylist(), group.column("blob"), strict=True):
            if kind == _MARKS:
                rows.append((chunk, chunk, _MARKS, _raw(blob)))
            else:
                sent[kind].append((chunk, _raw(blob)))
        for kind, got in sent.items():
            if not got:
                continue
            segs, sizes = Segments.unpack([blob for _, blob in got], length, k)
            chunks = np.repeat(np.array([chunk for chunk, _ in got]), sizes)
            doc, s, e, left = mark_all(segs, length)
            for chunk, part in _split(chunks[doc]):
                rows.append((chunk, chunk, _MARKS, zstandard.compress(np.stack([segs.ids[doc[part]], segs.keys[doc[part]], s[part], e[part]]).astype("<i8").tobytes(), 3)))
            if kind == _FIRST:
                for chunk, pick in _split(chunks[left.doc]):
                    for b, part in _split(_bucket(left, parts)[pick]):
                        rows.append((b, chunk, _LAST, left.take(pick[part], length).pack()))
        return _rows(_SENT, rows)

    return run


def spans(s: np.ndarray, e: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs of one document from its runs of windows."""
    if not len(s):
        return s, e
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order] + length - 1)
    head = np.concatenate([[True], s[1:] > e[:-1]])
    return s[head], e[np.concatenate([head[1:], [True]])]


_OUT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_MORE = [("kept_bytes", pa.binary()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))]


def _finish(length: int, with_text: bool):
    schema = pa.schema(_OUT + _MORE * with_text)

    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if runs.num_rows:
            ids, keys, s, e = np.concatenate([np.frombuffer(zstandard.decompress(_raw(b)), "<i8").reshape(4, -1) for b in runs.column("blob")], axis=1)
            order = np.lexsort((keys, ids))
            ids, keys, s, e = ids[order], keys[order], s[order], e[order]
            cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                found[int(ids[a]), int(keys[a])] = (s[a:b], e[a:b])
        none = np.zeros(0, np.int64)
        out: list[tuple] = []
        for doc_id, key, text in zip(docs.column("doc_id").to_pylist(), docs.column("row_key").to_pylist(), docs.column("text").cast(pa.binary()), strict=True):
            raw = _raw(text)
            s, e = spans(*found.get((doc_id, key), (none, none)), length)
            keep, at = [], 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                keep.append(raw[at:x])
                at = y
            left = b"".join([*keep, raw[at:]])
            out.append((doc_id, len(raw), len(raw) - len(left), len(s), hashlib.sha256(left).hexdigest(), *((left, s.tolist(), e.tolist()) if with_text else ())))
        return _rows(schema, out)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = GRAM, parts: int | None = None, block_bytes: int = BLOCK_BYTES, wide: int = WIDE, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept_bytes, span_starts, span_ends.

    parts is the number of chunks of documents and of buckets of k-grams (default: the session's shuffle partitions, and
    more of them where a chunk would hold more than CHUNK_BYTES of text, so that tasks are of one size at any scale); wide is the number of chunks beyond which a k-gram meets in two steps.
    Nulls: a null text is empty; a row with a null doc_id is left out. Texts shorter than `length` bytes keep every
    byte, and an empty table gives no rows. Ties: documents with one doc_id never remove each other's bytes; a row
    repeated as a whole gives its result row again. A text longer than block_bytes is cut into overlapping pieces, so
    no window is lost. Other columns are not read.
    """
    if not (1 <= k <= length and length - k <= 200):
        raise ValueError("k must be from length - 200 to length")
    if not parts:
        size = documents(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(shuffle_partitions(docs.sparkSession), -(-size // CHUNK_BYTES))
    d = documents(docs).select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    keys = "bucket int, chunk int, blob binary"
    grams = d.groupBy("chunk").applyInArrow(_list_grams(length, k, parts, block_bytes), keys)
    shared = grams.groupBy("bucket").applyInArrow(_find_shared(parts, wide), keys)
    rows = "bucket int, chunk int, kind byte, blob binary"
    runs = d.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send(length, k, parts, block_bytes, wide), rows)
    for _ in (_FIRST, _LAST):
        runs = runs.groupBy("bucket").applyInArrow(_meet(length, k, parts), rows)
    more = ", kept_bytes binary, span_starts array<long>, span_ends array<long>" if with_text else ""
    return d.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(_finish(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)
