"""Approximate nearest neighbours by cells and short codes of residuals, with a bound on the error of each code.

A vector of length 1 is the centre of its cell plus a residual; the residual, turned by a random rotation, is kept as four
bits a component, with the length of what they leave out. An inner product with a query is estimated from the code alone.
A random rotation spreads the error over all directions, so the estimate is off by about error / sqrt(dimension): rows whose
estimate comes within WIDTH of those of the k-th best are candidates, and only these are ranked by their vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bound
from .vectors import _doubles, _units

#: Errors by which the estimates of a candidate and of the k-th best may be off; rows in a batch of codes; most cells (broadcast).
WIDTH, BATCH, MOST_CELLS = 4.0, 2048, 65_536
#: Groups of cells: a query goes to each group at most once, whatever the number of cells it looks into.
GROUPS = 64
#: Rows that centres are learned from, for each of them; rows that the number of probes is measured on, and of these, asked ones.
TAUGHT, MEASURED, ASKED = 64, 20_000, 300


@dataclass(frozen=True)
class Coder:
    """Centres (rows), a rotation (rows), and how many cells a query looks into."""

    centres: np.ndarray
    turn: np.ndarray
    probes: int

    def cells(self, units: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each vector, the nearest first."""
        score = units @ self.centres.T - (self.centres**2).sum(1) / 2
        return np.argsort(-score, axis=1, kind="stable")[:, :n]

    def encode(self, units: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (two components a byte), the step of each code, and the length of its error."""
        y = (units - self.centres[cell]) @ self.turn.T
        step = np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-30) / 7.5
        level = np.clip(np.rint(y / step + 7.5), 0, 15).astype(np.uint8)
        error = np.sqrt(((y - (level - 7.5) * step) ** 2).sum(1))
        if level.shape[1] % 2:
            level = np.pad(level, ((0, 0), (0, 1)))
        return level[:, ::2] << 4 | level[:, 1::2], step[:, 0].astype("<f4"), error.astype("<f4")

    def decode(self, codes: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Turned residuals."""
        level = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : self.turn.shape[0]]
        return (level - 7.5) * step[:, None]


def _finite(c: str) -> Column:
    """Whether every component is a finite number."""
    return F.forall(c, lambda x: F.abs(x) < math.inf)


def fit_codes(vectors: DataFrame, recall: float = 0.95, k: int = 10, cells: int | None = None, rounds: int = 6, key: str = "vec_id", column: str = "embedding") -> Coder:
    """Cells as many as the root of the number of rows, learned by k-means over TAUGHT rows for each, and probes that find the share `recall`.

    Tasks assign rows and sum them up; the driver has the centres only. Rows are chosen by a hash of the key. The number of
    probes is measured on MEASURED rows at most. The dimension is that of most rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key), _doubles(column).alias("v")).where((F.size("v") > 0) & _finite("v"))
    most = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        raise ValueError("no vectors to learn cells from")
    dim, n = most
    rows = rows.where(F.size("v") == dim)
    cells = min(cells or math.ceil(math.sqrt(n)), MOST_CELLS)
    part = max(1, n // (TAUGHT * cells))
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(part)) == 0)
    centres = _units(r.v for r in sample.orderBy(F.xxhash64(key, F.lit(1)), key).limit(cells).collect())  # as many as there are cells
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Coder(centres, np.eye(dim), 1))

        def sums(parts, sent=sent):
            total, count = np.zeros_like(sent.value.centres), np.zeros(len(sent.value.centres))
            for pdf in parts:
                if len(pdf):
                    x = _units(pdf["v"])
                    at = sent.value.cells(x)[:, 0]
                    np.add.at(total, at, x)
                    np.add.at(count, at, 1)
            some = count > 0
            if some.any():  # a task without rows, as of a file's split without a row group, has no lists that Arrow could tell the kind of
                yield pd.DataFrame({"cell": np.flatnonzero(some), "n": count[some], "total": list(total[some])})

        got = sample.select("v").mapInPandas(sums, "cell long, n double, total array<double>").select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        centres = centres.copy()
        for cell, i, x, count in got.collect():  # cells times dimension
            centres[cell, i] = x / count
    turn = np.linalg.qr(np.random.default_rng(20_241).normal(size=(dim, dim)))[0]
    x = _units(r.v for r in rows.orderBy(F.xxhash64(key), key).limit(MEASURED).collect())  # bounded
    coder = Coder(centres, turn, len(centres))
    score = x[:ASKED] @ x.T
    score[np.arange(len(score)), np.arange(len(score))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(coder.cells(x[:ASKED], len(centres)), axis=1)
    needed = np.sort(np.take_along_axis(place, coder.cells(x)[:, 0][near], 1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) if len(needed) else len(centres)
    return Coder(centres, turn, probes)


def encoded(vectors: DataFrame, coder: Coder, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """cell, ids, codes, steps, errors (binary columns): the index of every row, in batches of one cell; to be stored partitioned by cell.

    A null key or vector, and one of another dimension or with a component that is no finite number, has no code and is nobody's neighbour.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(coder)
    dim = coder.turn.shape[0]

    def encode(parts):
        for pdf in parts:
            if len(pdf):
                x = _units(pdf["v"])
                cell = sent.value.cells(x)[:, 0]
                codes, step, error = sent.value.encode(x, cell)
                yield pd.DataFrame({"cell": cell, "id": pdf["id"], "code": [c.tobytes() for c in codes], "step": step, "error": error})

    def pack(parts):
        for pdf in parts:
            for cell, rows in pdf.groupby("cell", sort=False):
                for i in range(0, len(rows), BATCH):
                    r = rows.iloc[i : i + BATCH]
                    yield pd.DataFrame({"cell": [cell], "ids": [r["id"].to_numpy("<i8").tobytes()], "codes": [b"".join(r["code"])], "steps": [r["step"].to_numpy("<f4").tobytes()], "errors": [r["error"].to_numpy("<f4").tobytes()]})

    v = vectors.where(F.col(key).isNotNull() & (F.size(column) == dim)).select(F.col(key).cast("long").alias("id"), _doubles(column).alias("v")).where(_finite("v"))
    rows = v.mapInPandas(encode, "cell int, id long, code binary, step float, error float")
    # a cell of any size goes to as many tasks as its rows need
    return rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInPandas(pack, "cell int, ids binary, codes binary, steps binary, errors binary")


def asked_cells(queries: DataFrame, coder: Coder, key: str = "vec_id", column: str = "embedding", block: int = 512) -> DataFrame:
    """part, own, asked, hits (binary columns): packs of about `block` queries, once for each group of cells that any of them looks into.

    A query's vector goes to GROUPS parts at most, whatever the number of cells it looks into, which grows with the table.
    """
    sent = queries.sparkSession.sparkContext.broadcast(coder)
    dim, groups = coder.turn.shape[0], min(GROUPS, len(coder.centres))

    def ask(parts):
        """A pack's queries once for each group of cells that any of them looks into, with which of these cells each looks into."""
        for pdf in parts:
            for asked in pdf["asked"]:
                own, q = np.array([r["id"] for r in asked], "<i8"), _units(r["v"] for r in asked)
                probed = np.zeros((len(own), -(-len(sent.value.centres) // groups) * groups), bool)
                np.put_along_axis(probed, sent.value.cells(q, sent.value.probes), True, axis=1)
                for g in range(groups):
                    hits = probed[:, g::groups]
                    some = hits.any(axis=1)
                    if some.any():
                        yield pd.DataFrame({"part": [g], "own": [own[some].tobytes()], "asked": [q[some].tobytes()], "hits": [hits[some].tobytes()]})

    bound(queries.sparkSession)
    q = queries.where(F.col(key).isNotNull() & (F.size(column) == dim)).select(F.col(key).cast("long").alias("id"), _doubles(column).alias("v")).where(_finite("v"))
    packs = max(1, -(-q.count() // block))
    asked = q.groupBy(F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("id", "v")).alias("asked")).select("asked")  # about `block` queries
    return asked.mapInPandas(ask, "part int, own binary, asked binary, hits binary")


def candidates(index: DataFrame, queries: DataFrame, coder: Coder, k: int = 10, key: str = "vec_id", column: str = "embedding", block: int = 512) -> DataFrame:
    """query, id, estimate, doubt of the rows that may be among the k nearest of each query (its own row aside), by codes of its probed cells."""
    sent = queries.sparkSession.sparkContext.broadcast(coder)
    dim = coder.turn.shape[0]

    groups = min(GROUPS, len(coder.centres))

    def meet(parts):
        best: dict[int, np.ndarray] = {}  # of each query, the k highest lower bounds that this task has seen
        for pdf in parts:
            for r in pdf.itertuples():
                ids, steps, errors = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.steps, "<f4"), np.frombuffer(r.errors, "<f4")
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1)
                own = np.frombuffer(r.own, "<i8")
                some = np.frombuffer(r.hits, bool).reshape(len(own), -1)[:, r.cell // groups]
                own, q = own[some], np.frombuffer(r.asked).reshape(len(some), dim)[some]
                if not len(own):
                    continue
                found = (q @ sent.value.centres[r.cell])[:, None] + (q @ sent.value.turn.T) @ sent.value.decode(codes, steps).T
                found[own[:, None] == ids[None, :]] = -np.inf
                found[~np.isfinite(found)] = -np.inf
                doubt = WIDTH * errors / math.sqrt(dim)
                low = found - doubt
                low = np.partition(low, -k, axis=1)[:, -k:] if low.shape[1] > k else low
                old = np.stack([best[i] if i in best else np.full(k, -np.inf) for i in own.tolist()])
                kept = np.sort(np.concatenate([old, low], axis=1), axis=1)[:, -k:]
                best.update(zip(own.tolist(), kept, strict=True))
                i, j = np.nonzero((found + doubt >= kept[:, :1]) & np.isfinite(found))
                if len(i):
                    yield pd.DataFrame({"query": own[i], "id": ids[j], "estimate": found[i, j], "doubt": doubt[j]})

    asked = asked_cells(queries, coder, key, column, block)
    index = index.withColumn("cell", F.col("cell").cast("int"))  # a partition column may be read as text
    met = index.withColumn("part", F.col("cell") % groups).join(asked, "part").mapInPandas(meet, "query long, id long, estimate double, doubt double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.col("estimate") - F.col("doubt")), "id"))
    floor = met.withColumn("p", place).where(F.col("p") <= k).groupBy("query").agg(F.min(F.col("estimate") - F.col("doubt")).alias("floor"))
    return met.join(floor, "query").where(F.col("estimate") + F.col("doubt") >= F.col("floor")).select("query", "id", "estimate", "doubt")


def near_by_codes(index: DataFrame, vectors: DataFrame, queries: DataFrame, coder: Coder, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, place, key, score of about the k nearest vectors of each query by cosine: candidates by their codes, ranked by their vectors."""
    got = candidates(index, queries, coder, k, key, column)
    v = vectors.select(F.col(key).cast("long").alias("id"), _doubles(column).alias("x"))
    q = queries.select(F.col(key).cast("long").alias("query"), _doubles(column).alias("q"))
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("x", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = got.select("query", "id").join(q, "query").join(v, "id")
    scored = met.withColumn("n", size(F.col("x")) * size(F.col("q"))).select("query", "id", F.when(F.col("n") > 0, dot / F.col("n")).otherwise(0.0).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("query", "place", F.col("id").alias(key), "score")
