"""Hard negatives: for an anchor and each of its positives, the best rows of other labels whose score lies in a window below the positive's.

Scores are integer inner products. Vectors are rotated onto their principal axes (eigenvectors of the sum of outer products
of all rows), so the leading components carry most of a product. A pair's product over them is known up to the product of
the norms of what remains, plus slack for rounding, and a pair whose bounds lie outside the windows, or below the k-th
score already found, is discarded; the next components narrow the bounds of the others, and what survives is verified by
its integer product. Rows and anchors travel in packs; groups of packs of either side meet in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bound_batches, cut, release

#: Quantised components are held to this size, so that 100 times a product of up to 4096 components fits a long.
LARGEST = 1 << 22
#: Numbers in a pack, packs of rows and of anchors that meet in a task, and the fewest such groups of rows.
PACK_NUMBERS, ROW_PACKS, ANCHOR_PACKS, LEAST_GROUPS = 1 << 16, 128, 32, 24
_EMPTY, _NO_ID = np.int64(-(1 << 62)), np.int64((1 << 63) - 1)
_SLICE, _SURVIVORS = 1024, 1 << 16
_PACK = "first long, ids binary, labels binary, vectors binary, lows binary, highs binary"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (array<int>) of the rows that take part, one of each vec_id."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    held = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(scale)) * x.cast("double")))).cast("int")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.transform("embedding", held).alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of a column as rows of dim integers; missing last components are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype("<i4")
    out = np.zeros((len(sizes), dim), "<i4")
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _moments(dim: int):
    """i and the i-th row of the task's sum of outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    return run


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of all rows as columns, the one with most of the squared length first."""
    sums = rows.select("v").mapInArrow(_moments(dim), "i long, sums array<double>").select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    m = np.zeros((dim, dim))
    for i, j, x in sums.collect():  # dim * dim numbers
        m[i, j] = x
    return np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])


def _packed(dim: int, size: int):
    """Packs of up to size rows (vec_id, label, v, and lows and highs if there)."""

    def pack(t: pa.RecordBatch) -> list:
        raw = lambda c: b"" if c not in t.schema.names else np.ascontiguousarray(t.column(c).flatten().to_numpy(zero_copy_only=False), "<i8").tobytes()
        ids = t.column("vec_id").to_numpy().astype("<i8")
        return [int(ids[0]), ids.tobytes(), t.column("label").to_numpy().astype("<i8").tobytes(), _matrix(t.column("v"), dim).tobytes(), raw("lows"), raw("highs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in pack(batch.slice(i, size))], names=["first", "ids", "labels", "vectors", "lows", "highs"])

    return run


class _Side:
    """A pack of rows: ids, labels, integers, rotated components, and norms of what is left after each of the stages."""

    def __init__(self, pack: dict, dim: int, axes: np.ndarray, stages: list[int]) -> None:
        self.ids, self.labels = np.frombuffer(pack["ids"], "<i8"), np.frombuffer(pack["labels"], "<i8")
        self.whole = np.frombuffer(pack["vectors"], "<i4").reshape(len(self.ids), dim).astype(np.int64)
        self.turned = self.whole.astype(float) @ axes
        self.rest = [np.sqrt((self.turned[:, m:] ** 2).sum(1)) for m in stages]
        self.norm = np.sqrt((self.turned**2).sum(1))


class Best:
    """The k best rows in each window of each anchor of a pack, so far: higher scores first, then smaller ids."""

    def __init__(self, side: _Side, low: np.ndarray, high: np.ndarray, k: int, same: bool, stages: list[int]) -> None:
        self.a, self.low, self.high, self.k, self.same, self.stages = side, low, high, k, same, stages
        self.score, self.id = np.full((low.size, k), _EMPTY), np.full((low.size, k), _NO_ID)
        self.verified = 0

    def _open(self, i: np.ndarray | slice, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Which pairs may lie in a window of their anchor and above its k-th score."""
        floor = np.maximum(self.low, self.score[:, -1].reshape(self.low.shape))
        ok = np.zeros(upper.shape, bool)
        for w in range(self.low.shape[1]):
            f, h = floor[i, w], self.high[i, w]
            ok |= (upper >= f[:, None]) & (lower <= h[:, None]) if upper.ndim == 2 else (upper >= f) & (lower <= h)
        return ok

    def meet(self, r: _Side, part: slice, slack: float) -> None:
        a, m = self.a, self.stages[0]
        known = a.turned[:, :m] @ r.turned[part, :m].T
        doubt = a.rest[0][:, None] * r.rest[0][None, part] + slack * a.norm[:, None] * r.norm[None, part]
        mask = (a.labels[:, None] == r.labels[None, part]) == self.same
        mask &= a.ids[:, None] != r.ids[None, part]
        at_i, at_j = np.nonzero(self._open(slice(None), known + doubt, known - doubt) & mask)
        known = known[at_i, at_j]
        at_j = at_j + part.start
        for b in range(0, len(at_i), _SURVIVORS):
            self._verify(r, at_i[b : b + _SURVIVORS], at_j[b : b + _SURVIVORS], known[b : b + _SURVIVORS], slack)

    def _verify(self, r: _Side, i: np.ndarray, j: np.ndarray, known: np.ndarray, slack: float) -> None:
        a = self.a
        for s in range(1, len(self.stages)):
            m, n = self.stages[s - 1], self.stages[s]
            known = known + np.einsum("ij,ij->i", a.turned[i, m:n], r.turned[j, m:n])
            doubt = a.rest[s][i] * r.rest[s][j] + slack * a.norm[i] * r.norm[j]
            keep = self._open(i, known + doubt, known - doubt)
            i, j, known = i[keep], j[keep], known[keep]
        score = np.einsum("ij,ij->i", a.whole[i], r.whole[j])
        self.verified += len(score)
        n_windows = self.low.shape[1]
        rows, scores, ids = [], [], []
        for w in range(n_windows):
            ok = (score >= self.low[i, w]) & (score <= self.high[i, w]) & (score >= self.score[i * n_windows + w, -1])
            rows.append(i[ok] * n_windows + w)
            scores.append(score[ok])
            ids.append(r.ids[j[ok]])
        self._keep(np.concatenate(rows), np.concatenate(scores), np.concatenate(ids))

    def _keep(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        score, ids = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = order[place < self.k]
        self.score[touched], self.id[touched] = score[first].reshape(-1, self.k), ids[first].reshape(-1, self.k)

    def found(self) -> list[np.ndarray]:
        """anchor, window, row, score."""
        at, _ = np.nonzero(self.id != _NO_ID)
        some = self.id != _NO_ID
        n = self.low.shape[1]
        return [self.a.ids[at // n], at % n, self.id[some], self.score[some]]


def _search(dim: int, axes: np.ndarray, stages: list[int], k: int, same: bool):
    slack = dim * 2.0**-46

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [[np.zeros(0, np.int64)] * 4]
        for pack in left.select(["ids", "labels", "vectors", "lows", "highs"]).to_pylist():
            side = _Side(pack, dim, axes, stages)
            low, high = (np.frombuffer(pack[c], "<i8").reshape(len(side.ids), -1) for c in ("lows", "highs"))
            best = Best(side, low, high, k, same, stages)
            for x in range(right.num_rows):
                r = _Side({c: right.column(c)[x].as_py() for c in ("ids", "labels", "vectors")}, dim, axes, stages)
                for b in range(0, len(r.ids), _SLICE):
                    best.meet(r, slice(b, min(b + _SLICE, len(r.ids))), slack)
            got.append(best.found())
        release()
        return pa.table({c: pa.array(np.concatenate([g[n] for g in got]), pa.int64()) for n, c in enumerate(("anchor_id", "place", "other_id", "score"))})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, groups: tuple[int, int], search) -> DataFrame:
    """Every pack of anchors with every pack of rows: each group of one side with each of the other in a task."""
    h, g = groups
    own = lambda n: F.pmod(F.xxhash64("first"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("ids", "labels", "vectors", "lows", "highs", own(h).alias("h"), every(g).alias("g"))
    right = rows.select("ids", "labels", "vectors", own(g).alias("g"), every(h).alias("h"))
    return left.groupBy("h", "g").cogroup(right.groupBy("h", "g")).applyInArrow(search, "anchor_id long, place long, other_id long, score long")


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, leading: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x). Anchors are the rows whose vec_id anchor_every divides; an anchor's positives are the
    first `positives` other rows of its label by score, ties by smaller vec_id; for each of them the first `negatives` rows
    of other labels with low * positive <= 100 * score <= high * positive are returned, ranked from 1.
    Nulls: rows with a null vec_id, label or vector, or a null, infinite or NaN component, take no part. Of rows that repeat
    a vec_id, the one with the least (label, vector) does. Vectors of different lengths are filled with zeros; an empty
    one is all zeros. Quantised components beyond 2**22 either way are taken as that. An anchor without positives, or a
    positive without negatives, has no rows; an empty table gives none. Other columns are not read.
    """
    bound_batches(vectors.sparkSession)
    rows = cut(quantised(vectors, scale), "hn-rows")
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    axes = rotation(rows, dim)
    size, stages = max(64, PACK_NUMBERS // dim), sorted({min(dim, leading), min(dim, 2 * leading)})
    packed = cut(rows.mapInArrow(_packed(dim, size), _PACK), "hn-packs")
    anchors = cut(rows.where(F.col("vec_id") % anchor_every == 0), "hn-anchors")
    n_packs, n_anchors = packed.count(), anchors.count()
    groups = (max(1, -(-n_anchors // (size * ANCHOR_PACKS))), max(1, -(-n_packs // ROW_PACKS), min(n_packs, LEAST_GROUPS)))
    at = lambda x: F.array(F.lit(int(x)).cast("long"))
    everywhere = anchors.select("*", at(_EMPTY).alias("lows"), at(-_EMPTY).alias("highs"))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    found = _meet(everywhere.mapInArrow(_packed(dim, size), _PACK), packed, groups, _search(dim, axes, stages, positives, True))
    found = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives).select("anchor_id", "rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "hn-positives")
    # the windows of an anchor, one for each positive; an anchor with fewer has empty ones
    ceil_div, floor_div = f"({low} * positive_score + IF({low} * positive_score > 0, 99, 0)) div 100", f"({high} * positive_score - IF({high} * positive_score < 0, 99, 0)) div 100"
    edges = found.groupBy("anchor_id").agg(*[F.max(F.when(F.col("rank") == i + 1, F.expr(e))).alias(f"{n}{i}") for i in range(positives) for n, e in (("low", ceil_div), ("high", floor_div))])
    each = lambda n, none: F.array(*[F.coalesce(F.col(f"{n}{i}"), F.lit(int(none)).cast("long")) for i in range(positives)])
    windows = anchors.join(edges.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", each("low", -_EMPTY).alias("lows"), each("high", _EMPTY).alias("highs"))
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id")
    near = _meet(windows.mapInArrow(_packed(dim, size), _PACK), packed, groups, _search(dim, axes, stages, negatives, False)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    near = near.select("anchor_id", (F.col("place") + 1).cast("int").alias("of"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(found.withColumnRenamed("rank", "of"), ["anchor_id", "of"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
