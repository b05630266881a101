"""Vectors: cosine measures, codecs, exact nearest neighbours, and an index of cells around centres."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bound


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(c), F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for vectors of different length or without length. Norms may be given."""
    x, y = _doubles(a), _doubles(b)
    size = (norm(x) if norm_a is None else norm_a) * (norm(y) if norm_b is None else norm_b)
    return F.when((F.size(x) != F.size(y)) | (F.size(x) == 0) | (size == 0), F.lit(0.0)).otherwise(dot(x, y) / size)


def to_bytes(c: Column | str) -> Column:
    """float32, little-endian."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(c)


def from_bytes(c: Column | str) -> Column:
    """As many values as there are whole groups of 4 bytes."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))

    return run(c)


def id_bytes(s: str) -> bytes:
    """An identifier's bytes: decoded from hex where it is hex, else its own."""
    try:
        return bytes.fromhex(s)
    except ValueError:
        return s.encode()


def zero_embedder(texts: DataFrame, dimension: int = 768) -> DataFrame:
    """texts with a vector of zeros: the embedder that stands in when there is none."""
    return texts.withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), dimension))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors of the highest cosine with the query: key, score. Every task keeps its own k, and only those meet."""
    q = F.array(*(F.lit(float(struct.unpack("<f", struct.pack("<f", x))[0])) for x in query))
    return vectors.select(key, cosine(column, q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def similar_to(vectors: DataFrame, stored: int | str, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Neighbours of a stored vector, without itself; none if it is not there."""
    row = vectors.where(F.col(key) == stored).select(F.col(column).cast("array<double>").alias("v")).first()
    if row is None:
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    return nearest(vectors, row.v, k + 1, key, column).where(F.col(key) != stored).limit(k)


def _packs(queries: DataFrame, key: str, column: str, block: int, by: tuple[str, ...] = ()) -> DataFrame:
    """own, asked (binary): queries in packs of about `block` rows, or fewer within each value of `by`."""
    bound(queries.sparkSession)
    n = max(1, -(-queries.count() // block))
    q = queries.select(*by, F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("pack"), F.struct(F.col(key).cast("long").alias("id"), _doubles(column).alias("v")).alias("r"))

    def run(parts):
        for pdf in parts:
            for value, rows in zip(zip(*(pdf[c] for c in by), strict=True) if by else [()] * len(pdf), pdf["queries"], strict=True):
                yield pd.DataFrame({c: [x] for c, x in zip(by, value, strict=True)} | {"own": [np.array([r["id"] for r in rows], "<i8").tobytes()], "asked": [np.array([r["v"] for r in rows], "<f8").tobytes()]})

    packs = q.groupBy(*by, "pack").agg(F.collect_list("r").alias("queries")).drop("pack")
    return packs.mapInPandas(run, "".join(f"{c} {packs.schema[c].dataType.simpleString()}, " for c in by) + "own binary, asked binary")


def _batches(vectors: DataFrame, key: str, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ids, vs (binary): vectors in batches, as tasks read them: no row moves."""

    def run(parts):
        for pdf in parts:
            for value, rows in pdf.groupby(list(by), sort=False) if by else [((), pdf)]:
                for i in range(0, len(rows), 4096):
                    some = rows.iloc[i : i + 4096]
                    yield pd.DataFrame({c: [x] for c, x in zip(by, value, strict=True)} | {"ids": [some["id"].to_numpy("<i8").tobytes()], "vs": [np.array(list(some["v"]), "<f8").tobytes()]})

    bound(vectors.sparkSession)
    v = vectors.select(*by, F.col(key).cast("long").alias("id"), _doubles(column).alias("v"))
    kinds = "".join(f"{c} {v.schema[c].dataType.simpleString()}, " for c in by)
    return v.mapInPandas(run, f"{kinds}ids binary, vs binary")


def _best(met: DataFrame, k: int, key: str) -> DataFrame:
    """query, place, key, score from batches that met packs, each as matrix products; a batch keeps k rows for each query, and a second step k of those."""

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples():
                ids, owns = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.own, "<i8")
                if not len(ids) or not len(owns):
                    continue
                x, ys = np.frombuffer(r.vs).reshape(len(ids), -1), np.frombuffer(r.asked).reshape(len(owns), -1)
                length = np.linalg.norm(x, axis=1)
                for at in range(0, len(owns), 256):
                    y, own = ys[at : at + 256], owns[at : at + 256]
                    size = np.linalg.norm(y, axis=1)[:, None] * length[None, :]
                    score = np.where(size > 0, (y @ x.T) / np.where(size > 0, size, 1), 0.0)
                    score[(own[:, None] == ids[None, :]) | ~np.isfinite(score)] = -np.inf
                    least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -np.inf)
                    i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                    order = np.lexsort((ids[j], -score[i, j], i))
                    i, j = i[order], j[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) < k  # of ties with the last place, the smaller keys
                    i, j = i[kept], j[kept]
                    yield pd.DataFrame({"query": own[i], key: ids[j], "score": score[i, j]})

    kept = met.select("ids", "vs", "own", "asked").mapInPandas(run, f"query long, {key} long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))  # tasks keep k rows of a query each before they meet
    return kept.withColumn("place", place).where(F.col("place") <= k).select("query", "place", key, "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """query, place, key, score of the k nearest vectors of each query (its own row aside), exactly: each pack of queries meets each batch of vectors."""
    return _best(_batches(vectors, key, column).join(_packs(queries, key, column, block), how="cross"), k, key)


def _units(vs) -> np.ndarray:
    x = np.array(list(vs), float)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class Cells:
    """Centres (rows of length 1) and how many of the cells around them a query looks into."""

    centres: np.ndarray
    probes: int

    def ranked(self, units: np.ndarray) -> np.ndarray:
        """Cells of each vector, the nearest first."""
        return np.argsort(-(units @ self.centres.T), axis=1, kind="stable")


def fit_cells(vectors: DataFrame, cells: int = 16, recall: float = 0.95, k: int = 10, sample: int = 20_000, asked: int = 500, key: str = "vec_id", column: str = "embedding", rounds: int = 10) -> Cells:
    """Cells learned from a sample of at most `sample` rows, chosen by a hash of the key, by spherical k-means.

    The number of probes is the least that finds the share `recall` of the k nearest neighbours within the sample, for
    `asked` of its rows. Vectors without direction in common need most of the cells, clustered ones few.
    """
    rows = vectors.where(F.col(column).isNotNull()).select(_doubles(column).alias("v"), key).orderBy(F.xxhash64(key), key).limit(sample).collect()  # bounded
    if not rows:
        raise ValueError("no vectors to learn cells from")
    x = _units(r.v for r in rows)
    centres = x[:cells].copy()
    for _ in range(rounds):
        nearest_ = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    found = Cells(centres, len(centres))
    score = x[:asked] @ x.T
    score[np.arange(len(score)), np.arange(len(score))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(found.ranked(x[:asked]), axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, found.ranked(x)[:, 0][near], 1).ravel()) + 1
    return Cells(centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else len(centres))


def in_cells(vectors: DataFrame, cells: Cells, key: str = "vec_id", column: str = "embedding", probes: int = 1) -> DataFrame:
    """key, vector and cell: the index, with every row, to be stored partitioned by cell. With more probes: the nearest cells of each row.

    A null vector and one of another dimension have no cell and are nobody's neighbours.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(parts):
        for pdf in parts:
            if len(pdf):
                ranked = shared.value.ranked(_units(pdf[column]))[:, :probes]
                yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), ranked.shape[1]), column: pdf[column].repeat(ranked.shape[1]).to_numpy(), "cell": ranked.ravel()})

    v = vectors.where(F.size(column) == cells.centres.shape[1]).select(F.col(key).cast("long").alias(key), _doubles(column).alias(column))
    return v.mapInPandas(run, f"{key} long, {column} array<double>, cell int")


def near_in_cells(index: DataFrame, queries: DataFrame, cells: Cells, k: int = 10, key: str = "vec_id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """neighbours() within the probed cells of each query: packs of queries meet batches of their cells only, so a stored index is read by cell."""
    asked = _packs(in_cells(queries, cells, key, column, cells.probes), key, column, block, ("cell",))
    return _best(_batches(index, key, column, ("cell",)).join(asked, "cell"), k, key)


def index_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("count"), F.max(F.size(column)).alias("dimension"), F.lit(False).alias("needs_rebuild"))
