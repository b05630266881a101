"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature is VALUES minima of 16 bits each, and its distance to another the number of values that differ. It is split
into CHUNKS of equal length; by the pigeonhole principle two signatures that differ in fewer than 2 * CHUNKS values agree
in some chunk but for one value at most. That one error is enumerated: a chunk gives one key for each value left out, and
all pairs within the distance share a key. At the threshold itself (a similarity of 0.75) a pair shares no key with a
probability of about 1e-7, and higher similarities with a smaller one; nothing else is left to chance. Pairs whose sets
differ too much in size are passed over, which is exact, and every other pair is confirmed on the full sets of shingles.

Copies of one set are a class and take part once. Of the members of a key, first each is tried with the smallest, and
what that links is contracted. Keys whose members are still in different components make regions, one for each smallest member; their members outside the
region's largest component are compared with all members, in groups of a block of the former and a block of the latter
(regions.region_links). So no key is gathered whole, none is cut short, and documents are compared if they share keys with one
document (or in all that their keys lead to, where that takes fewer copies).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, documents, releasing, uncarried
from .common import swept_cut as cut
from .graph import components
from .regions import BLOCK_DOCS, BLOCK_SHINGLES, region_links

VALUES, CHUNKS = 48, 12
WIDTH = VALUES // CHUNKS
BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, lower-cased (A-Z) and split at ASCII white space."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    t = _LOWER[raw]
    blank = _BLANK[t]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    # sum of byte * base ** place, so that a word's hash is a difference, moved back to its own start
    power = np.full(len(t), _BASE)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.full(len(t), _BACK)
    back[:1] = 1
    back = np.multiply.accumulate(back)
    h = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    stops = np.cumsum([len(x) + 1 for x in texts])
    last = np.searchsorted(start, stops)
    shingle = h[: max(0, len(h) - words + 1)] * _PLACE[0]
    for j in range(1, words):
        shingle = shingle + h[j : len(shingle) + j] * _PLACE[j]
    shingle = _mixed(shingle)
    out, a = [], 0
    for b in last.tolist():
        n = b - a
        if n >= words:
            out.append(np.unique(shingle[a : b - words + 1]))
        elif n:
            out.append(_mixed((h[a:b] * _PLACE[32 : 32 + n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each of VALUES minima over the set."""
    low = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * _A + _B).min(axis=0))
    return (_mixed(low) & np.uint64(0xFFFF)).astype("<u2")


def text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    part, held, first = [], 0, 0
    for i, x in enumerate(batch.column("text").cast(pa.binary())):
        part.append(x.as_buffer().to_pybytes())
        held += len(part[-1])
        if held >= BLOCK_BYTES:
            yield first, part
            part, held, first = [], 0, i + 1
    if part:
        yield first, part


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch):
                sets = shingle_sets(texts, words)
                cols = [
                    batch.column("doc_id").slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "digest", "sig"])

    return run


def _sets(words: int):
    """rep and its set, of rows (doc_id, text, digest); a row of the same doc_id with another set is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch):
                ids, digests = (batch.column(c).slice(first, len(texts)).to_pylist() for c in ("doc_id", "digest"))
                got = [(i, s.tobytes()) for i, s, d in zip(ids, shingle_sets(texts, words), digests, strict=True) if hashlib.sha256(s.tobytes()).digest()[:16] == d]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())], names=["rep", "shingles"])

    return run


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows of VALUES): for each chunk one for each value left out."""
    v = sigs.astype(np.int64).reshape(len(sigs), CHUNKS, WIDTH)
    out = np.empty((len(sigs), CHUNKS, WIDTH), np.int64)
    for j in range(WIDTH):
        key = np.zeros((len(sigs), CHUNKS), np.int64)
        for i in range(WIDTH):
            if i != j:
                key = key << 16 | v[:, :, i]
        out[:, :, j] = key | (np.arange(CHUNKS) * WIDTH + j) << 48
    return out.reshape(len(sigs), -1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, VALUES)
            keys = chunk_keys(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), keys.shape[1]))], names=["key", "rep"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["u", "v"])

    return run


def full_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """rep, shingles of the asked representatives (rep)."""
    asked = asked.join(classes.select("rep", "digest"), "rep").withColumnRenamed("rep", "doc_id")
    return docs.join(asked, "doc_id").select("doc_id", "text", "digest").mapInArrow(releasing(_sets(words)), "rep long, shingles binary").dropDuplicates(["rep"])


def _star_links(docs: DataFrame, classes: DataFrame, met: DataFrame, words: int, percent: int) -> DataFrame:
    """u, v of the members of keys that are confirmed to be linked with the key's smallest member."""
    size = classes.select("rep", "n_shingles")
    pairs = met.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    p = pairs.join(size.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a")), "a").join(size.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b")), "b")
    # the intersection is no larger than the smaller set, nor the union smaller than the larger one
    pairs = cut(p.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b"), "nd-pairs")
    asked = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = cut(full_sets(docs, classes, asked, words), "nd-sets")
    p = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
    return p.select("a", "b", "set_a", "set_b").mapInArrow(releasing(_confirm(percent)), "u long, v long")


def open_regions(met: DataFrame, classes: DataFrame, roots: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """region, rep, root, n_shingles, dist (0) of the keys whose members are still in different components.

    The keys of one smallest member are a region. Regions that lead to each other are a family, which takes their place
    where that needs fewer copies of its members: where it fits one block, or has few members outside its largest
    component. In a large family of many components, members are compared with those of their own regions only.
    """
    # with two members, the only pair has been tried; a pair that many keys give is one row
    several = met.where("members > 2").select("rep", "least").distinct()
    several = cut(several.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "nd-several")
    apart = several.groupBy("least").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("least")
    several = cut(several.join(apart, "least").join(classes.select("rep", "n_shingles"), "rep"), "nd-open")
    family = components(several.where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    family = several.select("least").distinct().join(family.withColumnRenamed("node", "least").withColumnRenamed("root", "family"), "least", "left").withColumn("family", F.coalesce("family", "least"))
    several = cut(several.join(family, "least"), "nd-members")
    member = several.select("family", "rep", "root", "n_shingles").distinct()

    def copies(rows: DataFrame, *by: str) -> DataFrame:
        """Copies of members that comparing a region's blocks takes."""
        part = rows.groupBy(*by, "root").agg(F.count("*").alias("d"), F.sum("n_shingles").alias("s")).groupBy(*by)
        size = part.agg(F.sum("d").alias("d"), (F.sum("d") - F.max("d")).alias("o"), F.greatest(F.lit(1.0), F.sum("d") / block_docs, F.sum("s") / block_shingles).alias("b"))
        blocks = lambda n: F.ceil(F.col("b") * F.col(n) / F.col("d"))
        return size.select(*by, (F.col("d") * blocks("o") + F.col("o") * blocks("d")).alias("copies"))

    whole = copies(member, "family").join(copies(several, "family", "least").groupBy("family").agg(F.sum("copies").alias("parted")), "family")
    whole = whole.where("copies <= parted").select("family")
    one = member.join(whole, "family").select(F.concat(F.lit("family "), F.col("family").cast("string")).alias("region"), "rep", "root", "n_shingles")
    many = several.join(whole, "family", "left_anti").select(F.col("least").cast("string").alias("region"), "rep", "root", "n_shingles")
    return one.unionByName(many).withColumn("dist", F.lit(0.0))


def links(docs: DataFrame, classes: DataFrame, known: DataFrame, words: int, percent: int, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """node, root of the classes' representatives (classes: rep, digest, sig, n_shingles) that are linked to a smaller one; known: links (u, v) to add."""
    keyed = cut(classes.select("rep", "sig").mapInArrow(releasing(_keys), "key long, rep long"), "nd-keys")
    least = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("members")).where("least <> most")
    met = cut(keyed.join(least.select("key", "least", "members"), "key"), "nd-met")
    found = cut(_star_links(docs, classes, met, words, percent).unionByName(known), "nd-star")
    roots = components(found)
    members = cut(open_regions(met, classes, roots, block_docs, block_shingles), "nd-regions")
    if members.isEmpty():
        return roots
    more = region_links(members, full_sets(docs, classes, members.select("rep").distinct(), words), percent, block_docs, block_shingles)
    return components(found.unionByName(cut(more, "nd-links")))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 75, block_docs: int = BLOCK_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, then the columns named in carry.

    Documents are linked when 100 * intersection >= percent * union of their sets of `words`-word shingles (of fewer
    words, the whole sequence is the one shingle); component_id is the smallest doc_id that links lead to.
    Nulls: a null text is empty; an empty set is linked with nothing; a row with a null doc_id is left out. Ties: rows
    that repeat a doc_id are one document, in one component, whatever their texts; all of them are kept if it is (with
    carry, n_shingles is that of the largest set). An empty table gives no rows. A text of any length is one set, which
    one task holds (8 bytes a shingle). Columns of docs that are not carried are not read; a carried one may not be named
    like one of the result. percent below 75 is not covered by the signature's distance.
    """
    extra = carried(carry, "doc_id", "n_shingles", "component_id", "kept")
    if percent < 75 or not 1 <= words <= 32:
        raise ValueError("percent is 75 to 100, words 1 to 32")
    d = documents(docs)
    signed = cut(d.mapInArrow(releasing(_sign(words)), "doc_id long, n_shingles long, digest binary, sig binary"), "nd-signed")
    classes = cut(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles")), "nd-classes")
    # rows of one doc_id with different sets are one document
    several = signed.where("n_shingles > 0").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    same = signed.join(several, "doc_id").join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    roots = links(d, classes, same, words, percent, block_docs)
    named = cut(classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root")), "nd-named")
    out = signed.drop("sig").join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if not carry:
        return out
    more = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *extra)
    one = out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return more.join(one, "doc_id").select("doc_id", "n_shingles", "component_id", "kept", *uncarried(carry))
