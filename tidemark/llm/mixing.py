"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent between 1 (the corpus as it is) and 0 (all sources alike), found by bisection
so that the weights reach a target entropy or repeat no source more often than a limit. Each source then gets its part of
the token budget: whole passes over its documents, each with a pseudo-random permutation of its blocks of its own, and for
the rest the first blocks of one more permutation, down to a document within the last block.

Sources are rows of a table throughout: the bisection asks for sums over them, for a grid of exponents at a time, so
their number is not bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, cut, uncarried

BLOCKS, SEED = 256, 20_240_601
#: Exponents that one job tries at once, and how close the last two are.
GRID, CLOSE = 64, 1e-10
#: Rows of sources or of their blocks that are broadcast (about 100 bytes each); more of them are joined by a shuffle.
MOST_BROADCAST = 200_000
WORDS = r"[^\x20\x09-\x0D]+"


def weights(tokens: list[float], exponent: float) -> list[float]:
    """Normalised shares to the power of exponent; a source without tokens weighs nothing."""
    top = max(tokens, default=0)
    raw = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


class Sums:
    """What the weights of an exponent need of the sources: their number, most, least and all tokens, and sums of powers of shares of the most."""

    def __init__(self, sources: DataFrame):
        self.alive = sources.where("tokens > 0")
        r = self.alive.agg(F.count("*").alias("n"), F.max("tokens").alias("top"), F.min("tokens").alias("least"), F.sum("tokens").alias("total")).first()
        self.n, self.top, self.least, self.total = r.n, float(r.top or 0), float(r.least or 0), float(r.total or 0)

    def at(self, exponents: list[float]) -> dict[float, tuple[float, float]]:
        """Of each exponent: the sum of powers, and the entropy of the weights (nats)."""
        share = self.alive.select((F.col("tokens") / F.lit(self.top)).alias("r"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        power = F.pow("r", "a")
        got = share.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("r")).alias("s")).collect()
        return {x.a: (x.z, math.log(x.z) - x.a * x.s / x.z) for x in got}


def find_exponent(sums: Sums, target_entropy_share: float | None = None, repetition_limit: float | None = None, budget: float | None = None, cover: bool = False) -> float:
    """The smallest exponent, to CLOSE, whose weights keep to the entropy target and the repetition limit.

    The entropy falls and the least share rises with the exponent, so both conditions hold from some exponent on. A
    target below the corpus's own entropy or a limit that the corpus itself breaks gives 1.
    """

    def holds(a: float, z: float, h: float) -> bool:
        if target_entropy_share is not None and h > target_entropy_share * math.log(sums.n) + 1e-12:
            return False
        if repetition_limit is not None:
            # the smallest source is passed most often, the largest one least
            most, fewest = (sums.least / sums.top) ** a / (z * sums.least), 1 / (z * sums.top)
            scale = 1 / fewest if cover else (sums.total if budget is None else budget)
            return most * scale <= repetition_limit * (1 + 1e-12)
        return True

    if not sums.n:
        return 0.0
    low, high = 0.0, 1.0
    while high - low > CLOSE:
        grid = [low + (high - low) * i / GRID for i in range(GRID)]
        known = sums.at(grid)
        good = next((a for a in grid if holds(a, *known[a])), high)
        if good == low:  # only the first grid begins at an exponent that is not known to fail
            return low
        low, high = max(a for a in grid if a < good), good
    return high


def _hash(*cols: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _join(rows: DataFrame, small: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows with what small says; broadcast if it has few rows (n), else joined by keys that adaptive execution may split."""
    return rows.join(F.broadcast(small) if n <= MOST_BROADCAST else small.hint("merge"), keys)


def plan(base: DataFrame, target_entropy_share: float | None, repetition_limit: float | None, budget: float | None, cover: bool, seed: int) -> DataFrame:
    """Of base (source_key, doc_hash, block, n_tokens): a row per source, block and pass in which the block is taken.

    source_key, block, weight, passes, source_tokens, epoch, rank (of the block in the pass's permutation), before (tokens of
    the blocks before it in the pass), upto (the last document hash that is taken of it; null: all of them).
    """
    totals = cut(base.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    tokens = totals.groupBy("source_key").agg(F.sum("tokens").alias("tokens"))
    sums = Sums(tokens)
    a = find_exponent(sums, target_entropy_share, repetition_limit, budget, cover)
    z = sums.at([a])[a][0] if sums.n else 1.0
    # with cover, the largest source, which is passed least often, is passed once
    budget = z * sums.top if cover else sums.total if budget is None else budget
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(sums.top or 1.0), F.lit(a)) / F.lit(z)).otherwise(0.0)
    sources = tokens.select("source_key", weight.alias("weight"), F.col("tokens").cast("double").alias("source_tokens"))
    sources = sources.withColumn("passes", F.when(F.col("source_tokens") > 0, F.lit(budget) * F.col("weight") / F.col("source_tokens")).otherwise(1.0))
    sources = sources.withColumn("whole", F.floor(F.col("passes") + 1e-9).cast("int"))
    part = F.col("passes") - F.col("whole")
    sources = cut(sources.withColumn("left_tokens", F.when(part > 1e-9, part * F.col("source_tokens")).otherwise(0.0)), "mix-sources")
    n_sources = sources.count()
    passes = _join(totals, sources, ["source_key"], n_sources)
    passes = passes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole")))).where((F.col("epoch") < F.col("whole")) | (F.col("left_tokens") > 0))
    order = Window.partitionBy("source_key", "epoch").orderBy("block_hash", "block")
    passes = passes.withColumn("block_hash", _hash("source_key", "epoch", "block", seed=seed + 1))
    passes = passes.withColumn("rank", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    passes = cut(passes.where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("left_tokens"))), "mix-passes")
    # the block in which what is left of the budget runs out, and the document in it
    edge = passes.where((F.col("epoch") == F.col("whole")) & (F.col("before") + F.col("tokens") > F.col("left_tokens")))
    edge = edge.select("source_key", "block", (F.col("left_tokens") - F.col("before")).alias("room"))
    inside = _join(base, edge, ["source_key", "block"], n_sources)
    by_hash = Window.partitionBy("source_key").orderBy("doc_hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("sum", F.sum("n_tokens").over(by_hash)).where(F.col("sum") <= F.col("room"))
    last = edge.select("source_key", "block").join(taken.groupBy("source_key").agg(F.max("doc_hash").alias("last")), "source_key", "left")
    # of a block in which no document fits, none is taken: no hash is below the least
    last = last.select("source_key", "block", F.coalesce("last", F.lit(-(1 << 63))).alias("upto"), F.col("last").isNull().alias("none"), F.lit(True).alias("is_edge"))
    out = passes.join(last, ["source_key", "block"], "left").withColumn("ends", F.coalesce("is_edge", F.lit(False)) & (F.col("epoch") == F.col("whole")))
    out = out.where(~(F.col("ends") & F.coalesce("none", F.lit(False))))
    out = out.select("source_key", "block", "weight", "passes", "source_tokens", "epoch", "rank", "before", F.when(F.col("ends"), F.col("upto")).alias("upto"))
    return cut(out, "mix-plan")


def mix(docs: DataFrame, target_entropy_share: float | None = None, repetition_limit: float | None = None, budget: float | None = None, cover: bool = False, blocks: int = BLOCKS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and pass that the mixture holds: doc_id, source, n_tokens, weight, epoch, block_rank, progress, then the columns named in carry.

    target_entropy_share: the entropy to reach, as a share of that of equal weights. repetition_limit: most passes over
    a source. budget: tokens of the mixture (default: those of the corpus); cover: instead, as many as let every source
    be passed once at least, so that no document is lost. Each pass takes the blocks of a source in a permutation of its
    own; of the last one, documents are taken in that order as long as they fit into what is left. progress (0 to 1)
    interleaves the sources when rows are read in its order. Tokens are words (runs of other than white space).
    Nulls: a null text has no tokens, a null source is a source of its own; a row with a null doc_id is left out. A
    source without tokens is passed once. Ties: rows that repeat a doc_id go together; documents of one block have one
    progress. An empty table gives no rows. Texts are only counted, whatever their length. Columns of docs that are not
    carried are not read; a carried one may not be named like one of the result.
    """
    extra = carried(carry, "doc_id", "source", "n_tokens", "weight", "epoch", "block_rank", "progress")
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    d = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("source_key"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORDS)).cast("long").alias("n_tokens"), *extra,
    )
    doc_hash = _hash(F.col("doc_id"), seed=seed)
    d = d.withColumn("doc_hash", doc_hash).withColumn("block", F.pmod(F.shiftright(F.col("doc_hash"), 16), F.lit(blocks)).cast("int"))
    base = cut(d.select("doc_id", "source", "source_key", "n_tokens", "doc_hash", "block"), "mix-base")
    passes = plan(base, target_entropy_share, repetition_limit, budget, cover, seed)
    turn = F.array_sort(F.collect_list(F.struct("epoch", "rank", "before", "upto"))).alias("turns")  # a row per pass over the source
    passes = cut(passes.groupBy("source_key", "block", "weight", "passes", "source_tokens").agg(turn), "mix-turns")
    out = _join(d if carry else base, passes, ["source_key", "block"], passes.agg(F.sum(F.size("turns"))).first()[0] or 0)
    out = out.withColumn("t", F.explode("turns")).where(F.col("t.upto").isNull() | (F.col("doc_hash") <= F.col("t.upto")))
    place = F.col("t.before") / F.greatest(F.col("source_tokens"), F.lit(1.0))
    progress = F.least((F.col("t.epoch") + place) / F.greatest(F.col("passes"), F.lit(1e-9)), F.lit(1.0))
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), F.col("t.epoch").alias("epoch"), F.col("t.rank").alias("block_rank"), F.round(progress, 9).alias("progress"), *uncarried(carry))
