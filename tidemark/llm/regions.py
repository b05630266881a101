"""Regions of documents that may be linked: compared in blocks of bounded size, or divided by pivots first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import drop, release, releasing
from .common import swept_cut as cut
from .graph import components

#: Documents and shingles that a block of a region holds, about.
BLOCK_DOCS, BLOCK_SHINGLES = 600, 600_000
#: Pivots that divide a region, and what is added to windows of distances for rounding.
PIVOTS, SLACK = 16, 1e-9


def sketch_words(n: int) -> int:
    """Words of 64 bits in the sketch of a set of n: a power of two, with two bits for a shingle at least."""
    return 1 << max(0, (n - 1) >> 5).bit_length()


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles that fall on each bit."""
    bits = 64 * sketch_words(len(s))
    at = (s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes] | pa.ChunkedArray, words: int) -> np.ndarray:
    """A row of `words` words for each sketch: that of a smaller size follows from a larger one."""
    out = np.empty((len(sketches), words), np.uint64)
    for i, x in enumerate(sketches):
        x = np.frombuffer(x.as_buffer() if isinstance(x, pa.Scalar) else x, "<u8")
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)
    return out


def low_distances(a: np.ndarray, n_a: int, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Distances of a sketch to others of its number of words: a metric, and never above 1 - intersection / union of the sets.

    Where two sketches differ in a bit, the sets differ in a shingle on it, so the number of such bits, and the difference
    of the sizes, are at most the size d of the sets' symmetric difference; and 1 - intersection / union is
    2 d / (n_a + n_b + d), which grows with d.
    """
    d = np.maximum(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64), np.abs(n_b - n_a))
    return 2 * d / np.maximum(n_a + n_b + d, 1)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n and sketch of rep, shingles."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())], names=["rep", "n", "sketch"])


def _may_link(percent: int):
    """Rows of a group of _compare that its sketches do not rule out: for each of them, one of another side may be linked with it."""
    width = 1 - percent / 100 + SLACK

    def run(group: pa.Table) -> pa.Table:
        outer = group.column("side").to_numpy() == 1
        rep, root, inner, dist, n = (group.column(c).to_numpy() for c in ("rep", "root", "inner", "dist", "n"))
        flat = _folded(group.column("sketch"), sketch_words(int(n.min())))
        some = np.zeros(len(rep), bool)
        for i in np.flatnonzero(outer).tolist():
            may = np.flatnonzero(~outer & (inner | (rep < rep[i])) & (root != root[i]) & (np.abs(dist - dist[i]) <= width))
            may = may[low_distances(flat[i], n[i], flat[may], n[may]) <= width]
            some[may] = True
            some[i] |= len(may) > 0
        return group.select(DEALT).filter(pa.array(some))

    return run


#: Columns of members that are dealt to groups.
DEALT = ["region", "rep", "root", "inner", "dist", "side", "i", "j"]


def _compare(percent: int):
    """Links of a region between a block of its outer members (side 1) and a block of all its members (side 0).

    Documents whose distances to the region's pivot differ by more than the largest distance of a link are passed over.
    """
    width = 1 - percent / 100 + SLACK

    def run(group: pa.Table) -> pa.Table:
        outer = group.column("side").to_numpy() == 1
        rep, root, inner, dist = (group.column(c).to_numpy() for c in ("rep", "root", "inner", "dist"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("shingles")]
        sizes = np.array([len(x) for x in sets], np.int64)
        at = np.cumsum(sizes) - sizes
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        comp = np.unique(root, return_inverse=True)[1]
        marked = np.zeros(int(flat.max()) + 1, np.uint8)
        u, v = [], []
        for i in np.flatnonzero(outer).tolist():
            # two outer members meet in two groups, and are compared in one of them
            may = ~outer & (inner | (rep < rep[i])) & (comp != comp[i]) & (np.abs(dist - dist[i]) <= width) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            if not may.any():
                continue
            mine = flat[at[i] : at[i] + sizes[i]]
            marked[mine] = 1
            same = np.add.reduceat(marked[flat], at, dtype=np.int64)
            marked[mine] = 0
            for j in np.flatnonzero(may & (100 * same >= percent * (sizes + sizes[i] - same))).tolist():
                if comp[j] != comp[i]:
                    u.append(int(max(rep[i], rep[j])))
                    v.append(int(min(rep[i], rep[j])))
                    comp[comp == comp[j]] = comp[i]  # one link joins two components
        del sets, flat, marked
        release()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def region_links(
    members: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], percent: int, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, sketches: DataFrame | None = None
) -> DataFrame:
    """u, v of links between members of one region in different components; at least one for each two components that have any.

    members: region, rep, root, n_shingles, dist (to the region's pivot; 0 without one). sets: rep, shingles.
    The component that has most of a region is inner: its members need not be compared with each other. Every block of
    outer members meets every block of all members of its region, in a group of its own. Where sketches (rep, n, sketch) are
    given, these meet first, and sets only where a sketch leaves a link possible; sets is then a table, or gives the sets
    of a table's reps as a table of cut().
    """
    parts = members.groupBy("region", "root").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    blocks = lambda docs, shingles: F.ceil(F.greatest(docs / block_docs, shingles / block_shingles)).cast("int")
    most = F.max(F.struct("docs", "shingles", "root")).alias("m")
    size = parts.groupBy("region").agg(most, F.sum("docs").alias("d"), F.sum("shingles").alias("s")).where(F.col("d") > F.col("m.docs"))
    size = size.select("region", F.col("m.root").alias("main"), blocks(F.col("d"), F.col("s")).alias("all"), blocks(F.col("d") - F.col("m.docs"), F.col("s") - F.col("m.shingles")).alias("outer"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["region", "rep", "root", "inner", "dist"]
    # the inner members come once for each block of outer ones, which come once for each block of all
    here = members.join(size, "region").withColumn("inner", F.col("root") == F.col("main")).select(*cols, "all", "outer")
    dealt = here.select(*cols, F.lit(0).alias("side"), own("all").alias("i"), every("outer").alias("j")).unionByName(
        here.where(~F.col("inner")).select(*cols, F.lit(1).alias("side"), every("all").alias("i"), own("outer").alias("j"))
    )
    compared = lambda rows, sets: rows.join(sets, "rep").groupBy("region", "i", "j").applyInArrow(_compare(percent), "u long, v long")
    if sketches is None:
        return compared(dealt, sets)
    kinds = ", ".join(f"{c} {dict(dealt.dtypes)[c]}" for c in DEALT)
    some = cut(dealt.join(sketches, "rep").groupBy("region", "i", "j").applyInArrow(_may_link(percent), kinds), "mj-dealt")
    if isinstance(sets, DataFrame):
        return compared(some, sets)
    asked = sets(some.select("rep").distinct())
    links = cut(compared(some, asked), "mj-links")
    drop(asked)
    drop(some)
    return links


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same, len(both) - same


def _divide(percent: int):
    """Regions of a member among its region's pivots: its nearest pivot's, and those of pivots within the window; and whether it may be linked with the nearest.

    Distances are those of sketches, at the number of words that all of a region have. Members far from all pivots are a
    region of their own, without those windows; members that are nearly so far are in it too, for a link can shorten the
    distance to the nearest pivot by its own length only.
    """
    link = 1 - percent / 100
    wide, far = 2 * link + SLACK, 2 * link

    def apart(flat: np.ndarray, n: np.ndarray) -> list[int]:
        """Pivots that are far from the ones before them: others would only repeat a region."""
        kept: list[int] = []
        for i in range(len(n)):
            if (low_distances(flat[i], n[i], flat[kept], n[kept]) > far).all():
                kept.append(i)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[str, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for region, least, rep, n, mine, ids, sizes, theirs in zip(*(batch.column(c) for c in ("region", "least", "rep", "n", "sketch", "pivots", "pivot_n", "pivot_sketches")), strict=True):
                region, rep, n, words = region.as_py(), rep.as_py(), n.as_py(), sketch_words(least.as_py())
                if region not in used:
                    flat, sizes = _folded(theirs.as_py(), words), np.array(sizes.as_py(), np.int64)
                    kept = apart(flat, sizes)
                    used = {region: ([ids.as_py()[i] for i in kept], flat[kept], sizes[kept])}
                pivots, flat, sizes = used[region]
                dist = low_distances(_folded([mine], words)[0], n, flat, sizes).tolist()
                home = min(dist)
                if home > far - link - SLACK:
                    out.append((region, f"{region}/far", rep, None, home, False))
                if home > far:
                    continue
                nearest = pivots[dist.index(home)]
                out += [(region, f"{region}/{p}", rep, p, d, p == nearest and p != rep and d <= link + SLACK) for p, d in zip(pivots, dist, strict=True) if d <= home + wide]
            names = ["parent", "region", "rep", "pivot", "dist", "linked"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def _confirm(percent: int):
    """u, v of the pairs whose sets (set_a, set_b) are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [jaccard(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            linked = pa.array([100 * same >= percent * either for same, either in met], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(linked), batch.column("v").filter(linked)], names=["u", "v"])

    return run


def pair_links(pairs: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """u, v (the larger and the smaller) of the pairs (rep, pivot) that are linked, by their full sets; sets: see region_links."""
    asked = sets if isinstance(sets, DataFrame) else sets(pairs.select("rep").unionByName(pairs.select(F.col("pivot").alias("rep"))).distinct())
    both = pairs.select("rep", "pivot").join(asked.select("rep", F.col("shingles").alias("set_a")), "rep").join(asked.select(F.col("rep").alias("pivot"), F.col("shingles").alias("set_b")), "pivot")
    both = both.select(F.greatest("rep", "pivot").alias("u"), F.least("rep", "pivot").alias("v"), "set_a", "set_b")
    links = cut(both.mapInArrow(releasing(_confirm(percent)), "u long, v long"), "mj-links")
    if not isinstance(sets, DataFrame):
        drop(asked)
    return links


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def voronoi_join(
    members: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], found: DataFrame, percent: int, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, sketches: DataFrame | None = None
) -> DataFrame:
    """node, root after all links between members of one region, and the links already found (u, v).

    members: region (string), rep, n_shingles, dist (to the region's pivot). Distances are those of sketches (low_distances; made
    from the sets, which are then a table, if not given), and links are confirmed on full sets. A region of one component is done with. One
    that a block can hold is compared there, within windows of distance to its pivot. A larger one is divided: documents
    of it become pivots, each member goes to the region of its nearest pivot, and also to that of any pivot which is not
    farther than the nearest by more than twice the largest distance of a link; then two linked documents meet in the
    region of either one's nearest pivot, or in the region of those far from all. The new regions are joined in the same way. Where dividing would not halve the
    pairs to compare (members about equally far from all pivots), the region is compared in pairs of blocks instead.
    """
    if sketches is None:
        sketches = sets.select("rep", "shingles").mapInArrow(releasing(sketched), "rep long, n long, sketch binary")
    roots, level = components(found), 0
    while True:
        now = cut(_rooted(members.drop("root"), roots), "mj-members")
        size = now.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"), (F.min("root") != F.max("root")).alias("open")).where("open")
        large = F.greatest(F.col("docs") / block_docs, F.col("shingles") / block_shingles) > 1
        size = cut(size.select("region", "docs", large.alias("large")), "mj-sizes")
        small = now.join(size.where("NOT large").select("region"), "region")
        if size.where("large").isEmpty():
            found = cut(found.unionByName(region_links(small, sets, percent, block_docs, block_shingles, sketches)), "mj-links")
            return components(found)
        big = now.join(size.where("large").select("region"), "region").select("region", "rep").join(sketches, "rep")
        nth = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("rep", F.lit(level)), "rep"))
        pivots = big.select("region", "rep", "n", "sketch", nth.alias("nth")).where(F.col("nth") <= PIVOTS)
        pivots = pivots.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "sketch"))).alias("p"))  # PIVOTS sketches at most
        pivots = pivots.select("region", F.col("p.rep").alias("pivots"), F.col("p.n").alias("pivot_n"), F.col("p.sketch").alias("pivot_sketches"))
        pivots = pivots.join(big.groupBy("region").agg(F.min("n").alias("least")), "region")
        near = big.join(pivots, "region")
        near = cut(near.mapInArrow(releasing(_divide(percent)), "parent string, region string, rep long, pivot long, dist double, linked boolean"), "mj-near")
        # dividing pays where it leaves at most half of the pairs
        cost = near.groupBy("parent", "region").agg(F.count("*").alias("n")).groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        pays = cost.join(size.select(F.col("region").alias("parent"), "docs"), "parent").where(2 * F.col("pairs") <= F.col("docs") * F.col("docs")).select("parent")
        rest = now.join(size.where("large").select("region"), "region").join(pays.withColumnRenamed("parent", "region"), "region", "left_anti")
        links = region_links(small.unionByName(rest), sets, percent, block_docs, block_shingles, sketches).unionByName(pair_links(near.where("linked").select("rep", "pivot").distinct(), sets, percent))
        found = cut(found.unionByName(links), "mj-links")
        roots, level = components(found), level + 1
        members = near.join(pays, "parent").join(now.select("rep", "n_shingles").distinct(), "rep").select("region", "rep", "n_shingles", "dist")
