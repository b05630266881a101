"""Exact dedup through a log-structured merge index of digests.

Each task feeds the digests of its documents to a small LSM index: known digests are found by probing the runs' Bloom
filters and then the runs, new ones go to a memtable that flushes sorted runs, and runs of one level are compacted once
there are `fanout` of them. A task writes its index out whenever it holds HELD_ROWS digests. What tasks wrote is dealt
out by digest, sorted (Spark's sort spills) and compacted in one pass that holds a row at a time; compaction keeps the
best identifier and adds up the counts. The filter of the digests with two documents or more then goes to all tasks, and
documents that it lets through are sought in the index. Hits are compared, byte by byte, with the document that stays.
Only their texts are shuffled, the others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, documents, releasing, uncarried

MEMTABLE_ROWS, FANOUT, FILTER_BITS, PROBES = 16384, 4, 10, 4
#: Digests that a task's index holds before it is written out.
HELD_ROWS = 1 << 20
#: Most bits of the filter of hits that tasks share (8 MB): with more hits it lets more through, and loses none.
SHARED_BITS, SHARES = 1 << 26, 64
#: Rows of one digest that go to one task, at least; of larger groups there are N / HOT_ROWS at most.
HOT_ROWS = 20_000


class Bloom:
    """A Bloom filter of fixed-width digests."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.bits = max(64, bits)
        self.packed = np.zeros(-(-self.bits // 8), np.uint8) if packed is None else packed

    def _places(self, digests: np.ndarray) -> np.ndarray:
        words = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), digests.dtype.itemsize)
        a = np.zeros(len(digests), np.uint64)
        for j in range(min(8, words.shape[1])):
            a = (a << np.uint64(8)) | words[:, j]
        a = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        step = (a >> np.uint64(32)) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * step) % np.uint64(self.bits) for i in range(PROBES)])

    def add(self, digests: np.ndarray) -> None:
        p = self._places(digests).ravel()
        np.bitwise_or.at(self.packed, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def test(self, digests: np.ndarray) -> np.ndarray:
        p = self._places(digests)
        return (self.packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1)).all(axis=0)


class Run:
    """A sorted run: digests (fixed-width bytes, no two equal), best identifiers, counts, and a Bloom filter of the digests."""

    def __init__(self, digests: np.ndarray, best: np.ndarray, count: np.ndarray):
        self.digests, self.best, self.count = digests, best, count
        self.filter = Bloom(FILTER_BITS * len(digests))
        if len(digests):
            self.filter.add(digests)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The place of each digest in the run, or -1; only those that the filter lets through are searched."""
        out = np.full(len(digests), -1, np.int64)
        if len(self.digests) and len(digests):
            maybe = np.flatnonzero(self.filter.test(digests))
            at = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
            same = self.digests[at] == digests[maybe]
            out[maybe[same]] = at[same]
        return out


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], largest: bool) -> Run:
    """Compaction: one row per digest, with its smallest (or largest) identifier and the sum of the counts."""
    digests, best, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(digests):
        return Run(digests, best, count)
    order = np.argsort(digests, kind="stable")
    digests, best, count = digests[order], best[order], count[order]
    cuts = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]]))
    return Run(digests[cuts], (np.maximum if largest else np.minimum).reduceat(best, cuts), np.add.reduceat(count, cuts))


class LsmIndex:
    """Digest -> (best identifier, count) in levels of immutable sorted runs."""

    def __init__(self, width: int, largest: bool, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.width, self.largest, self.memtable_rows, self.fanout = width, largest, memtable_rows, fanout
        self.memtable: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.levels: list[list[Run]] = [[]]

    def add(self, digests: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        """Digests that a run has change its row; the others go to the memtable."""
        # the kind S ignores zero bytes at the end, which one width for all makes harmless
        d = np.array(digests, f"S{self.width}")
        for run in (r for level in self.levels for r in level):
            at = run.find(d)
            hit = at >= 0
            (np.maximum if self.largest else np.minimum).at(run.best, at[hit], ids[hit])
            np.add.at(run.count, at[hit], counts[hit])
            d, ids, counts = d[~hit], ids[~hit], counts[~hit]
        if len(d):
            self.memtable.append((d, ids, counts))
            self.held += len(d)
        if self.held >= self.memtable_rows:
            self.flush()

    def rows(self) -> int:
        return self.held + sum(len(r.digests) for level in self.levels for r in level)

    def flush(self) -> None:
        if self.memtable:
            self.levels[0].append(merge(self.memtable, self.largest))
            self.memtable, self.held = [], 0
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merge([(r.digests, r.best, r.count) for r in level], self.largest))
                self.levels[i] = []

    def get(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best identifier (0 if there is none) and count (0 likewise) of each digest, from the memtable and all runs."""
        self.flush()
        d = np.array(digests, f"S{self.width}")
        best, count = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        for run in (r for level in self.levels for r in level):
            at = run.find(d)
            hit = np.flatnonzero(at >= 0)
            new = run.best[at[hit]]
            old = best[hit]
            best[hit] = np.where(count[hit] == 0, new, np.maximum(old, new) if self.largest else np.minimum(old, new))
            count[hit] += run.count[at[hit]]
        return best, count

    def rest(self) -> Run:
        """All of it in one run: the major compaction."""
        self.flush()
        runs = [(r.digests, r.best, r.count) for level in self.levels for r in level]
        return merge(runs, self.largest) if runs else Run(np.zeros(0, f"S{self.width}"), np.zeros(0, np.int64), np.zeros(0, np.int64))


_INDEX = "digest binary, best long, n long"


def _batch(digests: list[bytes], best: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(best, pa.int64()), pa.array(count, pa.int64())], names=["digest", "best", "n"])


def _flush(width: int, largest: bool, memtable_rows: int, fanout: int, held_rows: int):
    """The rows of a task by its LSM index, in sorted runs."""

    def out(index: LsmIndex) -> Iterator[pa.RecordBatch]:
        r = index.rest()
        for i in range(0, len(r.digests), 10_000):
            part = slice(i, i + 10_000)
            yield _batch([x.ljust(width, b"\0") for x in r.digests[part].tolist()], r.best[part], r.count[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(width, largest, memtable_rows, fanout)
        for b in batches:
            if b.num_rows:
                index.add(b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy().astype(np.int64))
            if index.rows() >= held_rows:
                yield from out(index)
                index = LsmIndex(width, largest, memtable_rows, fanout)
        yield from out(index)

    return run


def _compact(width: int, largest: bool):
    """Rows in the order of their digests, one for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row whose digest may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            r = merge([(np.array(b.column(0).to_pylist(), f"S{width}"), b.column(1).to_numpy(), b.column(2).to_numpy())] + ([last] if last else []), largest)
            last = (r.digests[-1:], r.best[-1:], r.count[-1:])
            yield _batch([x.ljust(width, b"\0") for x in r.digests[:-1].tolist()], r.best[:-1], r.count[:-1])
        if last:
            yield _batch([x.ljust(width, b"\0") for x in last[0].tolist()], last[1], last[2])

    return run


_INDEX = "digest binary, best long, n long"


def merge_index(keyed: DataFrame, width: int = 32, largest: bool = False, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT, held_rows: int = HELD_ROWS) -> DataFrame:
    """digest, best, n of the rows (digest, id, count): an LSM index in each task, whose runs are compacted by digest."""
    runs = keyed.mapInArrow(releasing(_flush(width, largest, memtable_rows, fanout, held_rows)), _INDEX)
    return runs.repartition("digest").sortWithinPartitions("digest").mapInArrow(releasing(_compact(width, largest)), _INDEX)


def _with_id(digests: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Digests of (digest, identifier) pairs."""
    raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), -1).copy()
    mixed = (ids.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0x9E3779B97F4A7C15)
    pad = np.zeros((len(raw), max(8, raw.shape[1])), np.uint8)
    pad[:, : raw.shape[1]] = raw
    pad[:, :8] ^= mixed[:, None].view(np.uint8).reshape(-1, 8)
    return pad.view(f"S{pad.shape[1]}").ravel()


def _share(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), -1)[:, -1] % SHARES


def hit_filter(hits: DataFrame, n: int, width: int):
    """A column function (digest, doc_id): 2 where a row may be the one that stays of a hit (digest, best), 1 where its digest may be one, else 0.

    The filter is built in shares by the tasks that hold the hits; at most SHARED_BITS bits of it go to the driver and to all tasks.
    """
    bits = max(64, min(SHARED_BITS, 2 * FILTER_BITS * n) // SHARES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Bloom] = {}
        for b in batches:
            if b.num_rows:
                d = np.array(b.column(0).to_pylist(), f"S{width}")
                share = _share(d)
                for k in np.unique(share).tolist():
                    at = share == k
                    f = mine.setdefault(k, Bloom(bits))
                    f.add(d[at])
                    f.add(_with_id(d[at], b.column(1).to_numpy()[at]))
        yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int32()), pa.array([f.packed.tobytes() for f in mine.values()], pa.binary())], names=["share", "bits"])

    last = F.conv(F.hex(F.substring("digest", width, 1)), 16, 10).cast("int")
    dealt = hits.select("digest", "best").repartition(min(SHARES, 1 + n // 1_000_000), last % SHARES)
    filters: dict[int, np.ndarray] = {}
    for r in dealt.mapInArrow(build, "share int, bits binary").toLocalIterator():
        got = np.frombuffer(r.bits, np.uint8)
        filters[r.share] = filters[r.share] | got if r.share in filters else got
    shared = hits.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("byte")
    def probe(digest: pd.Series, doc_id: pd.Series) -> pd.Series:
        d, ids = np.array(digest.tolist(), f"S{width}"), doc_id.to_numpy()
        share, out = _share(d) if len(d) else np.zeros(0, np.uint8), np.zeros(len(d), np.int8)
        for k in np.unique(share).tolist():
            if k in shared.value:
                f, at = Bloom(bits, shared.value[k]), np.flatnonzero(share == k)
                hit = f.test(d[at])
                out[at] = hit
                out[at] += hit & f.test(_with_id(d[at], ids[at]))
        return pd.Series(out)

    return probe


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise=None, digest_bits: int = 256, carry: tuple[str, ...] = (), memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT, held_rows: int = HELD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, then the columns named in carry.

    keep: which doc_id of equal texts stays, "smallest" or "largest". normalise: a function of the text column, none by
    default. digest_bits: the index keeps that many bits of the SHA-256 (a multiple of 8); texts that share them but
    differ in their bytes are told apart by the verification. carry: columns of docs to return too.
    Nulls: a null text is the empty text and equals it; a row with a null doc_id is left out; nulls elsewhere stay.
    Ties: rows that repeat a doc_id with its text are all kept if that doc_id is, and each counts in group_size. An
    empty table gives no rows. A text of any length is hashed whole. Columns of docs that are not carried are not read,
    whatever their names; a carried one may not be named like one of the result.
    """
    if keep not in ("smallest", "largest") or digest_bits % 8 or not 8 <= digest_bits <= 256:
        raise ValueError("keep is smallest or largest; digest_bits is a multiple of 8 up to 256")
    largest, width = keep == "largest", digest_bits // 8
    d = documents(docs, *carried(carry, "doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    text: Column = normalise(F.col("text")) if normalise else F.col("text")
    d = d.select("doc_id", text.alias("norm"), *(F.col(f"carried_{i}") for i in range(len(carry))), F.sha2(text, 256).alias("text_sha256"))
    out = _resolve(d, [], largest, width, (memtable_rows, fanout, held_rows), hot_rows)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", *uncarried(carry))


def _resolve(d: DataFrame, salt: list[int], largest: bool, width: int, sizes: tuple[int, int, int], hot_rows: int) -> DataFrame:
    """d with keep_id and group_size in place of norm."""
    digest = F.unhex("text_sha256") if not salt else F.unhex(F.sha2(F.concat(F.lit(f"{salt[0]}:"), "norm"), 256))
    d = d.withColumn("digest", F.substring(digest, 1, width))
    index = cut(merge_index(d.select("digest", "doc_id", F.lit(1).cast("long").alias("n")), width, largest, *sizes), "lsm")
    hits = index.where("n > 1")
    n_hits, n_rows = hits.count(), index.agg(F.sum("n")).first()[0] or 0
    alone = lambda x: x.drop("digest", "norm", "probe").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    if not n_hits:
        return alone(d)
    d = d.withColumn("probe", hit_filter(hits, n_hits, width)("digest", "doc_id"))
    # the bytes of the documents that stay; rows that repeat one count once
    staying = d.where("probe = 2").select("digest", F.col("doc_id").alias("best"), F.col("norm").alias("s_text"))
    staying = cut(hits.join(staying, ["digest", "best"]).groupBy("digest", "best", "n").agg(F.min("s_text").alias("s_text")), "lsm-hits")
    # large groups are split, and what stays of them is sent to each part; there are 10,000 of them at most
    size = max(hot_rows, n_rows // 10_000)
    hot = hits.where(F.col("n") > size).select("digest", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    met = d.where("probe > 0").join(F.broadcast(hot), "digest", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts", "probe")
    sent = staying.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > size, F.ceil(F.col("n") / size).cast("int") - 1).otherwise(0))))
    met = met.join(sent, ["digest", "part"], "left").drop("part")
    rest = alone(d.where("probe = 0"))
    hit, differs = F.col("best").isNotNull(), F.col("s_text") != F.col("norm")
    if width == 32:
        checked = F.when(hit & differs, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.coalesce("best", "doc_id"))
        met = met.withColumn("keep_id", checked.cast("long")).withColumn("group_size", F.coalesce("n", F.lit(1)).cast("long"))
        return rest.unionByName(met.drop("digest", "norm", "best", "n", "s_text"))
    met = cut(met.withColumn("differs", differs), "lsm-verified")
    same = met.where(hit & ~F.col("differs")).drop("norm", "n", "s_text", "differs").withColumn("keep_id", F.col("best"))
    counts = same.groupBy("digest").agg(F.count("*").alias("group_size"))
    done = rest.unionByName(same.join(counts, "digest").drop("digest", "best")).unionByName(alone(met.where(~hit).drop("best", "n", "s_text", "differs")))
    other = met.where(hit & F.col("differs")).drop("digest", "best", "n", "s_text", "differs")
    return done if other.isEmpty() else done.unionByName(_resolve(other, [(salt or [0])[0] + 1], largest, width, sizes, hot_rows))
