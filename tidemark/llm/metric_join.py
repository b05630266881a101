"""Jaccard join of documents in the metric space of their shingle sets, with pivots, Voronoi regions and windows; exact.

The distance is 1 - intersection / union. Sets of unrelated documents are all at distance 1 of each other, where no window
could tell regions apart. So the first pivots are documents that have a piece of their set in common with another: sets of
about one size are dealt to so many chunks, by a hash of each shingle, that two linked sets must have a chunk in common
that is not empty (they differ in fewer shingles than they have such chunks). Each chunk's smallest document is a pivot,
and its region has the documents that have the chunk; two linked documents are in the region of one pivot at least.

Distances are taken between sketches of the sets, of two to four bits a shingle in place of 64: these are a metric, and never larger than
those of the sets (regions.low_distances), so what they put apart is not linked. What they leave is compared on full sets,
which are moved for no other pairs.

A document and the pivot that it has most chunks in common with are compared first, and links are contracted. A region that
is then one component is done with. In the others all distances to the pivot are computed, and they are joined
by regions.voronoi_join: within windows of distance to the pivot, and divided by pivots of their own as long as they are
large.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop, releasing
from .common import swept_cut as cut
from .graph import components
from .near_dedup import _mixed, full_sets, shingle_sets, text_blocks
from .regions import BLOCK_DOCS, BLOCK_SHINGLES, SLACK, _folded, low_distances, pair_links, sketch, sketch_words, voronoi_join

#: Largest size of a class of sets over its smallest, about, chunks beyond those that links may spoil, in hundredths, and bytes of a chunk's key.
RATIO, SPARE, KEY_BYTES = 1.5, 5, 6
#: Ids of texts to be read that are broadcast at most, in place of a shuffle of all texts.
MOST_IDS = 1_000_000


def bounds(percent: int, most: int = 1 << 40) -> list[int]:
    """Least sizes of the classes: a set is linked with sets of its own class and of the ones beside it only."""
    out, ratio = [1], max(RATIO, 100 / percent)
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return out


def chunk_keys(s: np.ndarray, percent: int, least: list[int]) -> np.ndarray:
    """Keys of a set's chunks, in its own class and, for links with smaller sets, in the one below.

    A linked set differs in `spoilt` shingles at most. With more chunks that are not empty than that, one of them is the
    same in both. Where one of two sets has fewer (its hashes clash), it takes twice as many chunks besides, and again, so
    that both have keys of the number of chunks that is enough for one of them.
    """
    k, spoilt, out = bisect_right(least, len(s)) - 1, (100 - percent) * len(s) // percent, []
    for c in (k, k - 1):
        if c < 0 or c < k and percent * len(s) > 100 * (least[c + 1] - 1):
            continue
        most = (100 - percent) * (least[c + 1] - 1) // percent
        n = most + 1 + most * SPARE // 100
        while True:
            chunk = s % np.uint64(n)
            order = np.argsort(chunk, kind="stable")
            chunk = chunk[order]
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            out.append(_mixed(np.add.reduceat(_mixed(s[order]), first) + _mixed(chunk[first] + np.uint64((n * 0x9E3779B97F4A7C15 + (c << 40)) % (1 << 64)))))
            if len(first) > spoilt:
                break
            n *= 2
    return np.concatenate(out)


def _packed(keys: np.ndarray) -> bytes:
    """KEY_BYTES of each key: keys that clash cost a comparison and change no result."""
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(packed: pa.Array) -> np.ndarray:
    low = np.frombuffer(b"".join(packed.to_pylist()), "u1").reshape(-1, KEY_BYTES)
    return np.concatenate([low, np.zeros((len(low), 8 - KEY_BYTES), "u1")], axis=1).view("<i8").ravel()


def _sign(words: int, percent: int, sketches: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = bounds(percent)
        for batch in batches:
            for first, texts in text_blocks(batch):
                sets = shingle_sets(texts, words)
                cols = [
                    batch.column("doc_id").slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()), pa.array([_packed(chunk_keys(s, percent, least)) if len(s) else b"" for s in sets], pa.binary()),
                ]
                names = ["doc_id", "n_shingles", "digest", "keys"]
                if sketches:
                    cols, names = [*cols, pa.array([sketch(s) for s in sets], pa.binary())], [*names, "sketch"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep and the keys of each row, one a row."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            n = pc.binary_length(part.column("keys")).to_numpy() // KEY_BYTES
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(part.column("keys"))), pa.array(np.repeat(part.column("rep").to_numpy(), n))], names=["key", "rep"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep and pivot, the key's smallest rep, of rows that come in the order of key and rep; a task holds one batch, however many rows a key has."""
    last, pivot = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rep = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
        fresh = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
        led = np.where(at >= 0, rep[np.maximum(at, 0)], pivot)
        last, pivot = key[-1], led[-1]
        some = led != rep
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(led[some])], names=["rep", "pivot"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dist = []
        for least, n_a, a, n_b, b in zip(*(batch.column(c) for c in ("least", "n_a", "a", "n_b", "b")), strict=True):
            flat = _folded([a, b], sketch_words(least.as_py()))
            dist.append(low_distances(flat[0], n_a.as_py(), flat[1:], np.array([n_b.as_py()]))[0])
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("pivot"), pa.array(dist, pa.float64())], names=["rep", "pivot", "dist"])


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """rep, pivot, dist of the pairs (rep, pivot, least: the smallest size of a set that takes part), by their sketches."""
    side = lambda rep, x: sketches.select(F.col("rep").alias(rep), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(x))
    both = pairs.join(side("rep", "a"), "rep").join(side("pivot", "b"), "pivot")
    both = both.withColumn("least", F.least("least", "n_a", "n_b"))  # null: of these two
    return cut(both.select("rep", "pivot", "least", "n_a", "a", "n_b", "b").mapInArrow(releasing(_distances), "rep long, pivot long, dist double"), "mj-distances")


def _asked_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """rep, shingles of the asked representatives (rep); only their texts are shuffled, unless there are more than MOST_IDS of them."""
    asked = cut(asked, "mj-asked")
    if asked.count() <= MOST_IDS:
        docs = docs.join(F.broadcast(asked.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    sets = cut(full_sets(docs, classes, asked, words), "mj-sets")
    drop(asked)
    return sets


def metric_join(docs: DataFrame, words: int = 4, percent: int = 85, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    Documents are linked when 100 * intersection >= percent * union of their sets of `words`-word shingles (of fewer
    words, the whole sequence is the one shingle); exact but for shingles of one 64-bit hash.
    Nulls: a null text is empty; an empty set is linked with nothing; a row with a null doc_id is left out. Ties: rows
    that repeat a doc_id are one document, in one component, whatever their texts, and a row each. An empty table gives no
    rows. A text of any length is one set, which one task holds (8 bytes a shingle). Other columns are not read.
    """
    if not 55 <= percent <= 100 or not 1 <= words <= 32:
        raise ValueError("percent is 55 to 100, words 1 to 32")
    d = documents(docs)
    keyed = cut(d.mapInArrow(releasing(_sign(words, percent, True)), "doc_id long, n_shingles long, digest binary, keys binary, sketch binary"), "mj-keyed")
    signed = cut(keyed.drop("keys", "sketch"), "mj-signed")
    some = signed.where("n_shingles > 0")
    classes = cut(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles")), "mj-classes")
    several = some.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    known = some.join(several, "doc_id").join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    # copies of a set are one document; keys meet once, in the order in which the smallest document of each comes first
    one = keyed.join(classes.select(F.col("rep").alias("doc_id"), "digest", "rep"), ["doc_id", "digest"]).select("rep", "keys").mapInArrow(releasing(_keys), "key long, rep long")
    led = one.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_led, "rep long, pivot long")
    pairs = cut(led.groupBy("rep", "pivot").agg(F.count("*").alias("n")), "mj-pairs")
    asked = pairs.select("rep").unionByName(pairs.select(F.col("pivot").alias("rep"))).distinct()
    sketches = keyed.select("doc_id", "digest", F.col("n_shingles").alias("n"), "sketch").join(asked.join(classes, "rep").select("rep", F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"])
    sketches = cut(sketches.select("rep", "n", "sketch").dropDuplicates(["rep"]), "mj-sketches")
    drop(keyed)
    sets = lambda asked: _asked_sets(d, classes, asked, words)
    nearest = pairs.groupBy("rep").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("x")).select("rep", (-F.col("x.p")).alias("pivot"), F.lit(None).cast("long").alias("least"))
    near = _near(nearest, sketches).where(F.col("dist") <= 1 - percent / 100 + SLACK)
    found = cut(pair_links(near, sets, percent).unionByName(known), "mj-found")
    # a region that is one component by now needs no distances
    roots = components(found)
    region = pairs.select("pivot", "rep").unionByName(pairs.select("pivot", F.col("pivot").alias("rep")).distinct()).join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    region = region.join(sketches.select("rep", "n"), "rep").groupBy("pivot").agg((F.min("root") != F.max("root")).alias("open"), F.min("n").alias("least"))
    left = cut(region.where("open").select("pivot", "least"), "mj-regions")
    members = _near(pairs.join(left, "pivot").select("rep", "pivot", "least"), sketches)
    members = members.unionByName(members.select("pivot").distinct().select(F.col("pivot").alias("rep"), "pivot", F.lit(0.0).alias("dist")))
    members = members.join(sketches.select("rep", F.col("n").alias("n_shingles")), "rep").select(F.col("pivot").cast("string").alias("region"), "rep", "n_shingles", "dist")
    roots = voronoi_join(members, sets, found, percent, block_docs, block_shingles, sketches)
    named = cut(classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root")), "mj-named")
    return signed.drop("keys").join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
