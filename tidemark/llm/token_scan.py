"""Token counts of the documents in flat, unindexed token files.

A token file is ids of a fixed width, one document after another, each closed by an end-of-document identifier; nothing
says where documents start. The file is read in blocks that ignore documents, each by the task that it is dealt to. Each
block is searched at once with a vectorised comparison. A prefix scan, over the blocks of each stretch of a file and then
over its stretches, tells how many tokens of an open document each block inherits, so that the lengths on both sides of a
border are stitched together.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, new_folder, shuffle_partitions

BLOCK_TOKENS = 1 << 18
#: Blocks of a stretch, which one task scans.
STRETCH = 4096
_BLOCKS = "file string, block long, data binary, marks array<long>"


def _store(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system that Python can open a path with, and the path in it; None where there is no such."""
    if re.match(r"^(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    try:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    except (OSError, ValueError, ImportError, pa.ArrowException):
        return None


def fitting_width(ranks: bytes, eod: int, width: int | None = None) -> int:
    """Bytes of an id: as many as the vocabulary and the end need (2 or 4), or those that are asked for if they fit."""
    most = max([eod, *(int(x.split()[1]) for x in ranks.splitlines() if x)])
    need = 2 if most < 1 << 16 else 4
    if width is None:
        return need
    if most >= 1 << (8 * width):
        raise ValueError(f"ids up to {most} do not fit into {width} bytes")
    return width


def read_ranges(files: DataFrame, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the token files (path, length; in a store that Python can open): file, block, data, marks (null).

    Rows of file, block, offset and length are dealt to tasks, and each task reads these ranges only; files of any size.
    """
    size = block_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, b, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if length % width:
                    raise ValueError(f"{name} does not hold whole tokens of {width} bytes")
                want = min(size, length - b * size)
                store, inside = _store(name)
                with store.open_input_file(inside) as f:
                    f.seek(b * size)
                    data = f.read(want)
                if len(data) != want:
                    raise ValueError(f"{name} has changed while it was read")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b], pa.int64()), pa.array([data], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "data", "marks"])

    last = F.floor((F.col("length") - 1) / size).cast("long")
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "length")
    return ranges.repartition(shuffle_partitions(files.sparkSession), "path", "block").mapInArrow(run, _BLOCKS)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the token files under path: file, block, data, marks (null).

    Where Python can open the store (local and shared folders, S3, GCS, HDFS with its client library), files of any size
    are read by ranges. Of other stores that Spark reads, a task takes a whole file, of up to 2 GB (a larger one fails).
    """
    if _store(path):
        return read_ranges(spark.read.format("binaryFile").load(path).select("path", "length"), width, block_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = block_tokens * width
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                if raw.size % width:
                    raise ValueError(f"{name} does not hold whole tokens of {width} bytes")
                for b, at in enumerate(range(0, raw.size, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b], pa.int64()), pa.array([raw[at : at + size].to_pybytes()], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "data", "marks"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _BLOCKS)


def token_stream(docs: DataFrame, ranks: bytes, pattern: str, eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The token files that writing docs out would give, as blocks: each task's documents, encoded with byte-level ranks, in a row.

    marks holds the doc_id of each document that ends in the block, in order: what a manifest beside the file would say.
    """
    fitting_width(ranks, eod, width)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        raw, split = shared.value
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        encoding = tiktoken.Encoding("tokens", pat_str=split, mergeable_ranks=table, special_tokens={})
        name, block = f"task-{TaskContext.get().partitionId()}", 0
        held: list[np.ndarray] = []
        marks: list[tuple[int, int]] = []  # place of the end, doc_id
        size = 0

        def take(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, marks, size, block
            flat = np.concatenate(held) if held else np.zeros(0, np.int64)
            at = 0
            while size - at >= n > 0 or (n == 0 and at < size):
                to = min(size, at + (n or block_tokens))
                ids = [d for p, d in marks if at <= p < to]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([flat[at:to].astype(f"<u{width}").tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "data", "marks"])
                block, at = block + 1, to
            held, marks, size = [flat[at:]], [(p - at, d) for p, d in marks if p >= at], size - at

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoding.encode_ordinary(text), eod], np.int64)
                held.append(ids)
                size += len(ids)
                marks.append((size - 1, doc_id))
                if size >= block_tokens:
                    yield from take(block_tokens)
        yield from take(0)

    return documents(docs).mapInArrow(run, _BLOCKS)


def write_token_files(docs: DataFrame, folder: str, ranks: bytes, pattern: str, eod: int, width: int = 2) -> DataFrame:
    """Writes docs as flat token files, one of each task, into the shared folder; their manifest: path, ordinal, doc_id, bytes.

    A task that is tried again writes another file, and the manifest names the files of successful tasks only.
    """
    fitting_width(ranks, eod, width)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    names = ["path", "ordinal", "doc_id", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        raw, split = shared.value
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        encoding = tiktoken.Encoding("tokens", pat_str=split, mergeable_ranks=table, special_tokens={})
        name, n = f"{folder}/{uuid.uuid4().hex}.bin", 0
        store, inside = _store(name)
        store.create_dir(inside.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inside) as f:
            for batch in batches:
                ids, sizes = batch.column(0).to_pylist(), []
                for text in batch.column(1).to_pylist():
                    data = np.array([*encoding.encode_ordinary(text), eod], f"<u{width}").tobytes()
                    f.write(data)
                    sizes.append(len(data))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(range(n, n + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=names)
                n += len(ids)

    return cut(documents(docs).mapInArrow(run, "path string, ordinal long, doc_id long, bytes long"), "token-manifest")


def _scan(eod: int, width: int):
    names = ["file", "block", "tokens", "ends", "head", "tail", "inner", "marks"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, block, data, marks in zip(*(batch.column(i) for i in range(4)), strict=True):
                a = np.frombuffer(data.as_buffer(), f"<u{width}")
                at = np.flatnonzero(a == eod)
                head = int(at[0]) if len(at) else len(a)
                tail = len(a) - int(at[-1]) - 1 if len(at) else len(a)
                out.append((file.as_py(), block.as_py(), len(a), len(at), head, tail, (np.diff(at) - 1).tolist(), marks.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def token_counts(blocks: DataFrame, eod: int, width: int = 2, stretch: int = STRETCH) -> DataFrame:
    """One row per document of the blocks: file, ordinal (from 0 in its file), n_tokens (without the end), closed, doc_id (null without marks).

    A last document without an end is returned with closed false if it has a token. Two ends in a row enclose a
    document of no tokens; repeated ends are never merged. An empty table of blocks gives no rows; a file without an end
    is one open document, of any length. blocks are file, block, data, marks, as read_token_files gives them; other
    columns are ignored. A block that is repeated is an error of the caller.
    """
    scanned = cut(blocks.select("file", "block", "data", "marks").mapInArrow(_scan(eod, width), "file string, block long, tokens long, ends long, head long, tail long, inner array<long>, marks array<long>"), "token-scan")
    # the scan is over a few numbers a block; the place after the last end is counted from the stretch's start
    s = scanned.select("file", "block", "tokens", "ends", "tail", F.floor(F.col("block") / stretch).alias("part"))
    w = Window.partitionBy("file", "part").orderBy("block")
    s = s.withColumn("upto", F.sum("tokens").over(w)).withColumn("after", F.when(F.col("ends") > 0, F.col("upto") - F.col("tail")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    s = s.withColumn("start", sums("tokens", before)).withColumn("earlier", sums("ends", before)).withColumn("last_end", F.max("after").over(before))
    whole = s.groupBy("file", "part").agg(F.sum("tokens").alias("tokens"), F.sum("ends").alias("ends"), F.max("after").alias("after"), F.max("block").alias("last_block"))
    v = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("p_start", sums("tokens", v)).withColumn("p_earlier", sums("ends", v)).withColumn("p_end", F.col("p_start") + F.col("after"))
    whole = whole.withColumn("p_last", F.coalesce(F.max("p_end").over(v), F.lit(0))).withColumn("final_block", F.max("last_block").over(Window.partitionBy("file")))
    s = s.join(whole.select("file", "part", "p_start", "p_earlier", "p_last", "final_block"), ["file", "part"])
    start = F.col("p_start") + F.col("start")
    s = s.select("file", "block", (start - F.coalesce(F.col("p_start") + F.col("last_end"), F.col("p_last"))).alias("carried"), (F.col("p_earlier") + F.col("earlier")).alias("earlier"), (F.col("block") == F.col("final_block")).alias("final"))
    s = scanned.hint("merge").join(s, ["file", "block"])
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tokens"))
    open_ = F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>"))
    s = s.select("file", "earlier", "ends", "marks", F.posexplode(F.concat(closed, open_)).alias("i", "n_tokens"))
    return s.select("file", (F.col("earlier") + F.col("i")).alias("ordinal"), "n_tokens", (F.col("i") < F.col("ends")).alias("closed"), F.get("marks", F.col("i")).alias("doc_id"))


def document_token_counts(docs: DataFrame, ranks: bytes, pattern: str, eod: int, width: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens of every document: its token files, scanned for ends.

    The files are written to the shared folder and read by ranges; if that folder is in a store that Python cannot open,
    the stream is scanned without files. width: bytes of an id, by default as many as the vocabulary needs; ids that do
    not fit are an error. Nulls: a null text is empty, a document of no tokens; a row with a null doc_id is left out.
    Repeated rows are counted each, and ties have no effect. Texts are encoded whole; of other columns none is read.
    """
    width = fitting_width(ranks, eod, width)
    folder = new_folder(docs.sparkSession, "tokens")
    if not _store(folder):
        return token_counts(token_stream(docs, ranks, pattern, eod, width, block_tokens), eod, width).select("doc_id", "n_tokens")
    manifest = write_token_files(docs, folder, ranks, pattern, eod, width)
    files = manifest.groupBy("path").agg(F.sum("bytes").alias("length"))
    counts = token_counts(read_ranges(files, width, block_tokens), eod, width).drop("doc_id")
    said = manifest.select(F.col("path").alias("file"), "ordinal", "doc_id")
    # the manifest is small as Parquet but grows with the documents: never broadcast
    return said.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
