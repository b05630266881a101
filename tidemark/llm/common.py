"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows in an Arrow batch, in place of Spark's default of 64 MB: a worker holds several copies of a batch.
BATCH_BYTES, _DEFAULT_BYTES = 8 << 20, "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches, unless the session asks for a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == _DEFAULT_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; a row without doc_id is no document and is left out."""
    bound_batches(df.sparkSession)
    return df.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *extra,
    )


def carried(carry: tuple[str, ...], *own: str) -> list[Column]:
    """The columns named in carry under names that nothing else has; a name that the operator returns itself is refused."""
    if clash := {c.lower() for c in carry} & {c.lower() for c in own}:
        raise ValueError(f"rename these columns before they are carried, for the operator returns its own: {', '.join(sorted(clash))}")
    return [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]


def uncarried(carry: tuple[str, ...]) -> list[Column]:
    return [F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set, a local session (as in tests) gets a temporary one; on a cluster that is an error, for other
    machines could not read it.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over the batches of a task, and then release()."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release()

    return run


_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; discard() deletes what lies there."""
    _made.append(f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def cut(df: DataFrame, label: str, sweep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs nothing; sweep: see swept()."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if sweep:
        swept(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


swept_cut = partial(cut, sweep=True)


def drop(df: DataFrame) -> None:
    """Deletes a table of cut() that nothing is still to be read from."""
    _made.remove(df.written_at)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a plan when the driver collects its garbage; without this, those of all steps lie on the disks until it happens to."""
    gc.collect()
    spark._jvm.System.gc()


def made() -> int:
    """How many folders the operators of this process have made; a mark for discard()."""
    return len(_made)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables made since the mark. What still reads them, results not yet written among it, cannot be run any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_made) > since:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def one_label(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and the 0 or 1 in a column of at most `most` training rows, chosen by a hash of the id; an id with both teaches nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & is_training("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(F.col(column).cast("int")).alias(column), F.max(F.col(column).cast("int")).alias("other")).where(F.col(column) == F.col("other")).drop("other")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fitting(sizes: list[tuple[int, int, int]], most_bytes: int) -> list[int]:
    """Ids of (id, label, bytes), in their order, of the texts that fit most_bytes together: one that does not fit is passed over, the next may.

    Of a label that none of these has, the smallest text is taken besides, whatever its size.
    """
    taken, held, labels = [], 0, set()
    for i, label, size in sizes:
        if held + size <= most_bytes:
            taken.append(i)
            labels.add(label)
            held += size
    for label in {x[1] for x in sizes} - labels:
        taken.append(min((size, n, i) for n, (i, x, size) in enumerate(sizes) if x == label)[2])
    return taken


def taught(docs: DataFrame, known: DataFrame, column: str, most_bytes: int) -> DataFrame:
    """doc_id, label and text of the known rows; one text of an id that is repeated, and most_bytes of text in all (see fitting), in the order of a hash."""
    got = documents(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(column).alias(column), F.min("text").alias("text"))  # known: a bounded sample
    sizes = got.select("doc_id", column, F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # of the sample
    fit = fitting([tuple(r) for r in sizes], most_bytes)
    return got.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fit], "doc_id long")), "doc_id")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_training(doc_id: Column | str) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2
