"""A full-text index that is kept by its changes, with ranked search that skips blocks of postings. All of it is partitioned Parquet.

    documents/segment=/              doc, length, range
    postings/segment=/bucket=/       term, range, n, max_tf, min_length, docs, tfs, lengths, positions: a block for each term and range
    terms/segment=/head=/            term, documents, occurrences: the dictionary, sorted
    deleted/change=/segment=/        doc: documents of older segments that a change has replaced or deleted
    log/                             change, segment, live: one file a change, which makes all that it has written visible at once

A range holds up to BLOCK documents of about one length, the same ones for all terms of a segment (one of more than LONG terms
has a range of its own); a block is what a term has in a range, and all blocks of a range are made in one group. With its largest frequency and its smallest length, a block bounds the score that its term can add to any document,
whatever the mean length and the number of documents have become since. Segments are never changed: a change writes one of its
own, and merges put segments of about one size together. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import BUCKETS, K1, B, Near, Phrase, QueryError, _bucket, leaves, parse, terms
from .shared import delete, exists

#: Documents in a range (a power of two), ranges that a first pass reads, segments of a size that are merged, and places of a column.
BLOCK, FIRST, FAN, PLACES = 128, 16, 4, 1 << 32
#: Terms of a document beyond which it shares its range with no other, so that a group of texts or blocks is bounded.
LONG = 1 << 14


def head(term: Column) -> Column:
    """The dictionary's partition of a term: its first letter or digit, of those in ASCII."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise("other")


def _possible(tree, has: dict[Phrase, Column]) -> Column:
    """Whether a document of a range can match, by which leaves occur in the range."""
    if isinstance(tree, Phrase):
        return has[tree]
    left = _possible(tree.left, has)
    if tree.kind == "not":
        return left
    right = _possible(tree.right, has)
    return left & right if tree.kind == "and" else left | right


def _matches(tree, f: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return f[tree] > 0
    left, right = _matches(tree.left, f), _matches(tree.right, f)
    return left & right if tree.kind == "and" else left | right if tree.kind == "or" else left & ~right


def _phrases(tree) -> list[Phrase]:
    if isinstance(tree, Near):
        raise QueryError("NEAR is searched by bm25_index")
    return [tree] if isinstance(tree, Phrase) else _phrases(tree.left) + _phrases(tree.right)


def _score(f: Column, length: Column, idf: float, mean: float) -> Column:
    f = f.cast("double")
    return F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean)))


def _packed(number: pa.Scalar, names: pa.Array, code: np.ndarray, docs: pa.Array, tf: np.ndarray, length: np.ndarray, positions: pa.ListArray) -> pa.Table:
    """The blocks of a range, from its postings in the order of their terms' codes."""
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = pa.array(np.append(starts, len(code)), pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(ends, x)
    least = lambda f, x: f.reduceat(x, starts) if len(starts) else x
    return pa.table({
        "term": names.take(pa.array(code[starts])), "range": pa.repeat(number, len(starts)), "n": pa.array(np.diff(ends.to_numpy()), pa.int64()),
        "max_tf": pa.array(least(np.maximum, tf), pa.int32()), "min_length": pa.array(least(np.minimum, length), pa.int32()),
        "docs": listed(docs), "tfs": listed(pa.array(tf, pa.int32())), "lengths": listed(pa.array(length, pa.int32())), "positions": listed(positions),
    })


def _text_blocks(t: pa.Table) -> pa.Table:
    """Blocks of a range's documents: doc, length, and lines of terms (_t0, _t1, ..)."""
    t = t.sort_by([("doc", "ascending"), ("n", "ascending")]).combine_chunks()
    row, word, place = [], [], []
    for i in range(sum(c.startswith("_t") for c in t.column_names)):
        words = pc.split_pattern(t[f"_t{i}"].combine_chunks(), " ")
        offsets, at = words.offsets.to_numpy(), pc.list_parent_indices(words).to_numpy()
        some = np.flatnonzero(pc.not_equal(flat := words.flatten(), "").to_numpy(zero_copy_only=False))
        row.append(at[some].astype(np.int64))
        word.append(flat.take(pa.array(some)))
        place.append((some + offsets[0] - offsets[at[some]]) + i * PLACES)
    coded = pa.concat_arrays(word).dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * t.num_rows + np.concatenate(row)
    order = np.argsort(key, kind="stable")  # places of a term in a document stay in order
    key, place = key[order], np.concatenate(place)[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(starts, len(key))
    code, at = np.divmod(key[starts], t.num_rows)
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int64()))
    return _packed(t["range"][0], coded.dictionary, code, t["doc"].combine_chunks().take(pa.array(at)), np.diff(ends), t["length"].to_numpy()[at], positions)


def _merged_blocks(t: pa.Table) -> pa.Table:
    """Blocks of a range, from those of the ranges (segment, old) that are put together in it, without the documents in gone."""
    t = t.combine_chunks()
    at = pc.list_parent_indices(t["docs"].combine_chunks())
    e = pa.table({c: t[c].combine_chunks().flatten() for c in ("docs", "tfs", "lengths", "positions")} | {"code": t["term"].combine_chunks().dictionary_encode().indices.take(at)})
    old = t.select(["segment", "old"]).to_pandas().groupby(["segment", "old"]).ngroup().to_numpy()
    once = pa.array(np.unique(old, return_index=True)[1])  # gone is the same list in all blocks of a range
    gone = t["gone"].combine_chunks().take(once)
    lost = gone.flatten()
    if len(lost):
        ids = pa.concat_arrays([e["docs"].combine_chunks(), lost]).dictionary_encode()
        ids, wide = ids.indices.to_numpy().astype(np.int64), len(ids.dictionary)
        dead = ids[len(at) :] + pc.list_parent_indices(gone).to_numpy() * wide  # of the n-th range, as in old
        e = e.filter(pa.array(~np.isin(ids[: len(at)] + old[at.to_numpy()] * wide, dead)))
    e = e.take(pc.sort_indices(e, [("code", "ascending"), ("docs", "ascending")])).combine_chunks()
    names = t["term"].combine_chunks().dictionary_encode().dictionary
    column = lambda c: e[c].combine_chunks()
    return _packed(t["range"][0], names, column("code").to_numpy().astype(np.int64), column("docs"), column("tfs").to_numpy(), column("lengths").to_numpy(), column("positions"))


@dataclass(frozen=True)
class Segments:
    """The index below path of the named columns of rows with a key.

    Nulls: a null text has no terms; a row with a null key is left out. Rows that repeat a key within one change are
    documents of their own. An empty change writes an empty segment. Texts of any length are indexed whole.
    """

    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]
    key_type: str = "long"
    buckets: int = BUCKETS
    block: int = BLOCK

    def _schema(self, name: str) -> str:
        return {
            "documents": f"doc {self.key_type}, length int, range long, segment long",
            "postings": f"term string, range long, n long, max_tf int, min_length int, docs array<{self.key_type}>, tfs array<int>, lengths array<int>, positions array<array<long>>, segment long, bucket int",
            "terms": "term string, documents long, occurrences long, segment long, head string",
            "deleted": f"doc {self.key_type}, change long, segment long",
        }[name]

    # -- what is visible ------------------------------------------------------------------------------------------------

    def state(self) -> tuple[list[int], list[int]]:
        """Live segments, and changes that are visible: of the log, which has some rows a change."""
        if not exists(self.spark, f"{self.path}/log"):
            return [], []
        live: dict[int, bool] = {}
        rows = sorted(tuple(r) for r in self.spark.read.schema("change long, segment long, live boolean").parquet(f"{self.path}/log").collect())
        for _, segment, on in rows:
            if segment >= 0:
                live[segment] = on
        return sorted(s for s, on in live.items() if on), sorted({r[0] for r in rows})

    def _read(self, name: str, segments: list[int]) -> DataFrame:
        """A table's rows of these segments; a merged segment's files may be gone."""
        if not segments:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/segment={s}" for s in segments))

    def _deleted(self, segments: list[int], changes: list[int]) -> DataFrame | None:
        """doc, segment of what is deleted in these segments; None if nothing is."""
        found = [p for c in changes if exists(self.spark, p := f"{self.path}/deleted/change={c}")]
        if not found:
            return None
        gone = self.spark.read.schema(self._schema("deleted")).option("basePath", f"{self.path}/deleted").parquet(*found)
        return gone.where(F.col("segment").isin(segments)).select("doc", "segment").distinct()

    @staticmethod
    def _without(rows: DataFrame, deleted: DataFrame | None) -> DataFrame:
        return rows if deleted is None else rows.join(deleted, ["segment", "doc"], "left_anti")

    def documents(self) -> DataFrame:
        """segment, doc, length, range of the documents that are there."""
        segments, changes = self.state()
        return self._without(self._read("documents", segments).select("segment", "doc", "length", "range"), self._deleted(segments, changes))

    def vocabulary(self) -> DataFrame:
        """term, documents, occurrences over the documents that are there."""
        segments, changes = self.state()
        deleted = self._deleted(segments, changes)
        dirty = [r[0] for r in deleted.select("segment").distinct().collect()] if deleted is not None else []  # segments
        rows = self._counts([s for s in segments if s not in dirty])
        if dirty:  # documents that are there must be told from others
            rows = rows.unionByName(self._entries(self._read("postings", dirty), deleted).select("term", F.lit(1).cast("long").alias("n"), F.col("tf").cast("long").alias("tf")))
        return rows.groupBy("term").agg(F.sum("n").alias("documents"), F.sum("tf").alias("occurrences"))

    def _counts(self, segments: list[int]) -> DataFrame:
        """term, n, tf: documents and occurrences in each block."""
        return self._read("postings", segments).select("term", "n", F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x).alias("tf"))

    def _entries(self, blocks: DataFrame, deleted: DataFrame | None, *more: str) -> DataFrame:
        """A row for each document of each block: segment, range, term, doc, tf, length, then the columns named in more (their elements)."""
        names = {"docs": "doc", "tfs": "tf", "lengths": "length"} | {c: c for c in more}
        rows = blocks.select("segment", "range", "term", F.explode(F.arrays_zip(*names)).alias("e"))
        return self._without(rows.select("segment", "range", "term", *(F.col(f"e.{c}").alias(n) for c, n in names.items())), deleted)

    # -- changes --------------------------------------------------------------------------------------------------------

    def change(self, upserts: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Adds or replaces rows (key and columns) and deletes keys; returns the number of the change. What it writes follows its own size."""
        segments, changes = self.state()
        n = max(changes, default=-1) + 1
        gone = [x.select(F.col(self.key).alias("doc")) for x in (upserts, deleted) if x is not None]
        if segments and gone:
            dead = self.documents().join(reduce(DataFrame.unionByName, gone).distinct(), "doc", "left_semi").select("doc", "segment")
            dead.write.mode("overwrite").partitionBy("segment").parquet(f"{self.path}/deleted/change={n}")
        if upserts is not None:
            self._add(n, upserts)
        self._commit(n, [(n, n, True)] if upserts is not None else [(n, -1, True)])
        return n

    def _add(self, n: int, upserts: DataFrame) -> None:
        """Segment n of rows. Texts are dealt by their sizes and split into terms once; then a range's documents meet, and its blocks are made there."""
        names = [f"_t{i}" for i in range(len(self.columns))]
        d = upserts.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("doc"), *(F.coalesce(F.col(c), F.lit("")).alias(t) for c, t in zip(self.columns, names, strict=True)))
        ordered = d.withColumn("size", sum((F.octet_length(t) for t in names), F.lit(0))).repartitionByRange("size", "doc").sortWithinPartitions("size", "doc")
        at = f"{self.path}/texts/segment={n}"
        ordered.select("doc", F.monotonically_increasing_id().alias("n"), *(F.array_join(terms(t), " ").alias(t) for t in names)).write.mode("overwrite").parquet(at)
        lines = self.spark.read.schema(f"doc {self.key_type}, n long, {', '.join(f'{t} string' for t in names)}").parquet(at)
        words = lambda t: F.when(F.col(t) == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
        lines = lines.withColumn("length", sum((words(t) for t in names), F.lit(0)).cast("int"))
        alone = F.col("n").bitwiseOR(F.lit(1 << 62))  # no other number of a range is as large
        lines = lines.withColumn("range", F.when(F.col("length") > LONG, alone).otherwise(F.shiftright("n", int(math.log2(self.block)))))
        self._write(n, lines.select("doc", "length", "range"), lines.groupBy("range").applyInArrow(_text_blocks, self._made()))
        delete(self.spark, at)

    def _made(self) -> str:
        return self._schema("postings").removesuffix(", segment long, bucket int")

    def _write(self, n: int, documents: DataFrame, blocks: DataFrame) -> None:
        """Segment n of documents (doc, length, range) and their blocks. Tasks write the blocks of their ranges to all buckets."""
        at = f"segment={n}"
        documents.write.mode("overwrite").parquet(f"{self.path}/documents/{at}")
        blocks = blocks.withColumn("bucket", _bucket(F.col("term"), self.buckets)).sortWithinPartitions("bucket", "term", "range")
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{at}")
        known = self._counts([n]).groupBy("term").agg(F.sum("n").alias("documents"), F.sum("tf").alias("occurrences"))
        known = known.withColumn("head", head(F.col("term"))).repartitionByRange("head", "term").sortWithinPartitions("head", "term")
        # version 2 pages code each term by what it shares with the one before, and keep the least and greatest of each page
        known.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").partitionBy("head").parquet(f"{self.path}/terms/{at}")

    def _commit(self, n: int, rows: list[tuple[int, int, bool]]) -> None:
        self.spark.createDataFrame(rows, "change long, segment long, live boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def merge(self, fan: int = FAN) -> list[list[int]]:
        """Merges segments of about one size (a power of fan) while there are fan of them; deleted documents go. Returns what was merged."""
        done: list[list[int]] = []
        while True:
            segments, changes = self.state()
            # a segment without documents has no row, and may be merged with any
            size = {r.segment: r.n for r in self.documents().groupBy("segment").agg(F.count("*").alias("n")).collect()}
            tiers: dict[int, list[int]] = {}
            for s in segments:
                tiers.setdefault(int(math.log(max(1, size.get(s, 0)), fan)), []).append(s)
            ready = next((t for _, t in sorted(tiers.items()) if len(t) >= fan), None)
            if ready is None:
                return done
            n, gone = max(changes) + 1, self._deleted(ready, changes)
            self._join(n, ready, gone)
            self._commit(n, [(n, n, True), *((n, s, False) for s in ready)])
            done.append(ready)

    def _join(self, n: int, ready: list[int], gone: DataFrame | None) -> None:
        """Segment n of the documents of others. Ranges are put together whole: of those with at most a half (a quarter, ..) of the block, two (four, ..) of about one length."""
        documents = self._read("documents", ready).select("segment", "doc", "length", F.col("range").alias("old"))
        there = self._without(documents, gone)
        fits = F.when(F.col("length") > LONG, 0).otherwise(F.floor(F.log2(F.lit(float(self.block)) / F.col("n")) + 1e-9)).cast("int")
        # a row for each range, of its documents that are there
        old = there.groupBy("segment", "old").agg(F.count("*").alias("n"), F.max("length").alias("length")).withColumn("fits", F.greatest(fits, F.lit(0)))
        at = f"{self.path}/ranges/segment={n}"
        ordered = old.repartitionByRange("fits", "length", "segment", "old").sortWithinPartitions("fits", "length", "segment", "old")
        ordered.select("segment", "old", "fits", F.monotonically_increasing_id().alias("i")).write.mode("overwrite").parquet(at)
        number = F.expr("shiftleft(shiftleft(shiftright(i, fits), fits), 6) + fits")
        ranges = self.spark.read.schema("segment long, old long, fits int, i long").parquet(at).select("segment", "old", number.alias("range"))
        blocks = self._read("postings", ready).select("segment", F.col("range").alias("old"), "term", "docs", "tfs", "lengths", "positions").join(ranges, ["segment", "old"])
        if gone is None:
            blocks = blocks.withColumn("gone", F.lit(None).cast(f"array<{self.key_type}>"))
        else:  # as many as a range has documents
            dead = documents.join(gone, ["segment", "doc"], "left_semi").groupBy("segment", "old").agg(F.collect_set("doc").alias("gone"))
            blocks = blocks.join(dead, ["segment", "old"], "left")
        self._write(n, there.join(ranges, ["segment", "old"]).select("doc", "length", "range"), blocks.groupBy("range").applyInArrow(_merged_blocks, self._made()))
        delete(self.spark, at)

    # -- search ---------------------------------------------------------------------------------------------------------

    def prefixed(self, prefix: str) -> DataFrame:
        """segment, term, documents, occurrences of the dictionary's terms with a prefix: of one partition, and of the pages that have such terms.

        Counts are those of the segment when it was written; what was deleted since goes with the next merge.
        """
        segments, _ = self.state()
        first = prefix[:1] if prefix[:1].isascii() and prefix[:1].isalnum() else "other"
        known = self._read("terms", segments).where(F.col("term") >= prefix)
        known = known.where(F.col("term").startswith(prefix))
        return (known.where(F.col("head") == first) if prefix else known).select("segment", "term", "documents", "occurrences")

    def _blocks(self, segments: list[int], word: str) -> DataFrame:
        bucket = self.spark.range(1).select(_bucket(F.lit(word), self.buckets)).first()[0]
        return self._read("postings", segments).where((F.col("bucket") == bucket) & (F.col("term") == word))

    def _starting(self, segments: list[int], prefix: str) -> DataFrame:
        """Blocks of the terms with a prefix, from their buckets only (as many numbers as there are buckets, at most)."""
        known = self.prefixed(prefix).select("term").distinct()
        buckets = [r[0] for r in known.select(_bucket(F.col("term"), self.buckets)).distinct().collect()]
        return self._read("postings", segments).where(F.col("bucket").isin(buckets)).join(known, "term", "left_semi") if buckets else self._read("postings", segments).where("false")

    def _rows(self, leaf: Phrase, segments: list[int], deleted: DataFrame | None) -> DataFrame:
        """segment, range, doc, length, f: all documents with a leaf that has several words, a prefix or a column."""
        if leaf.column and leaf.column not in self.columns:
            raise QueryError(f"no such column: {leaf.column}")
        found: DataFrame | None = None
        for k, word in enumerate(leaf.words):
            blocks = self._starting(segments, word) if leaf.prefix and k == len(leaf.words) - 1 else self._blocks(segments, word)
            at = self._entries(blocks, deleted, "positions").select("segment", "range", "doc", "length", F.explode("positions").alias("place"))
            at = at.withColumn("place", F.col("place") - k)
            found = at if found is None else found.unionByName(at)
        if found is None:
            return self._entries(self._read("postings", segments).where("false"), None).select("segment", "range", "doc", "length", F.col("tf").alias("f"))
        if leaf.column:
            at = self.columns.index(leaf.column) * PLACES
            found = found.where((F.col("place") >= at) & (F.col("place") < at + PLACES))
        if len(leaf.words) > 1:  # a start has every word of the phrase at its place
            found = found.groupBy("segment", "range", "doc", "length", "place").agg(F.count("*").alias("words")).where(F.col("words") == len(leaf.words))
        return found.groupBy("segment", "range", "doc", "length").agg(F.count("*").alias("f"))

    def ranked(self, query: str, limit: int | None = 20, told: dict | None = None) -> DataFrame:
        """key, rank of the documents that match, best first, as bm25 gives them over the same documents; ties by the key.

        The first FIRST ranges by bound are read; with `limit` matches in them, the last one's score is a threshold, and
        only ranges whose bound reaches it are read besides. Without, more ranges are. Single words are read by block;
        phrases, prefixes and words of one column are found in all of theirs first, for their number is part of the rank.
        told: gets the postings of the query's words, and how many of them were read.
        """
        tree = parse(query)
        every, wanted = list(dict.fromkeys(_phrases(tree))), list(dict.fromkeys(leaves(tree)))
        segments, changes = self.state()
        deleted = self._deleted(segments, changes)
        dirty = [r[0] for r in deleted.select("segment").distinct().collect()] if deleted is not None else []  # segments
        deleted = deleted if dirty else None
        plain = [len(p.words) == 1 and not p.prefix and not p.column for p in every]
        source = [self._blocks(segments, p.words[0]) if easy else self._rows(p, segments, deleted) for p, easy in zip(every, plain, strict=True)]
        metas, counts = [], []
        for i, (df, easy) in enumerate(zip(source, plain, strict=True)):
            if easy:
                meta = df.select(F.lit(i).alias("leaf"), "segment", "range", "n", F.col("max_tf").cast("long").alias("f"), "min_length")
                clean = meta.where(~F.col("segment").isin(dirty)) if dirty else meta
                counts.append(clean.groupBy("leaf").agg(F.sum("n").alias("n")))
                if dirty:  # deleted documents do not count
                    counts.append(self._entries(df.where(F.col("segment").isin(dirty)), deleted).groupBy(F.lit(i).alias("leaf")).agg(F.count("*").alias("n")))
            else:
                meta = df.groupBy(F.lit(i).alias("leaf"), "segment", "range").agg(F.count("*").alias("n"), F.max("f").alias("f"), F.min("length").alias("min_length"))
                counts.append(meta.groupBy("leaf").agg(F.sum("n").alias("n")))
            metas.append(meta)
        have: dict[int, int] = {}
        for leaf, n in reduce(DataFrame.unionByName, counts).collect():  # two numbers a leaf
            have[leaf] = have.get(leaf, 0) + n
        total, mean = self.documents().agg(F.count("*"), F.avg("length")).first()
        idf = [max(math.log((total - have.get(i, 0) + 0.5) / (have.get(i, 0) + 0.5)), 1e-6) for i in range(len(every))]
        scored = [every.index(p) for p in wanted]
        meta = reduce(DataFrame.unionByName, metas)
        bound = reduce(lambda a, i: F.when(F.col("leaf") == i, _score(F.col("f"), F.col("min_length"), idf[i], mean or 1.0)).otherwise(a), scored, F.lit(0.0))
        has = {p: F.max(F.col("leaf") == i) for i, p in enumerate(every)}
        ranges = meta.withColumn("b", bound).groupBy("segment", "range").agg(F.sum("b").alias("bound"), F.sum("n").alias("postings"), *(h.alias(f"h{i}") for i, h in enumerate(has.values())))
        ranges = ranges.where(_possible(tree, {p: F.col(f"h{i}") for i, p in enumerate(every)})).select("segment", "range", "bound", "postings")

        def scores(chosen: DataFrame) -> DataFrame:
            lowest, highest = chosen.agg(F.min("range"), F.max("range")).first()
            each = []
            for i, (df, easy) in enumerate(zip(source, plain, strict=True)):
                near = df.where(F.col("range").between(lowest if lowest is not None else 0, highest if highest is not None else -1)).join(chosen.select("segment", "range"), ["segment", "range"], "left_semi")
                got = self._entries(near, deleted).withColumnRenamed("tf", "f") if easy else near
                each.append(got.select("segment", "doc", "length", F.lit(i).alias("leaf"), F.col("f").cast("long").alias("f")))
            d = reduce(DataFrame.unionByName, each).groupBy("segment", "doc").agg(F.max("length").alias("length"), *(F.sum(F.when(F.col("leaf") == i, F.col("f")).otherwise(0)).alias(f"f{i}") for i in range(len(every))))
            d = d.where(_matches(tree, {p: F.col(f"f{i}") for i, p in enumerate(every)}))
            score = reduce(lambda s, i: s + _score(F.col(f"f{i}"), F.col("length"), idf[i], mean or 1.0), scored, F.lit(0.0))
            return d.select(F.col("doc").alias(self.key), (-score).alias("rank"))

        if limit is None:
            return scores(ranges)
        ask = FIRST
        while True:
            first = ranges.orderBy(F.desc("bound"), "segment", "range").limit(ask).collect()
            best = scores(self.spark.createDataFrame([tuple(r) for r in first], ranges.schema)).orderBy("rank", self.key).limit(limit).collect() if first else []
            if len(best) == limit or len(first) < ask:
                break
            ask *= 8
        # a bound is no smaller than a score, but for rounding
        least = -best[-1].rank * (1 - 1e-9) if len(best) == limit else -1.0
        chosen = ranges.where(F.col("bound") >= least)
        if told is not None:
            told["postings"] = meta.agg(F.sum("n")).first()[0] or 0
            told["read"] = chosen.agg(F.sum("postings")).first()[0] or 0
            told["first"] = sum(r.postings for r in first)
        return scores(chosen).orderBy("rank", self.key).limit(limit)
