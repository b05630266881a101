"""Quality rules with robust multivariate outliers.

Each document becomes a short vector of transformed text statistics. Per language and source the minimum-covariance-
determinant estimate of centre and scatter is found over all documents of the group by concentration steps: distances
under the present estimate, the share of nearest documents, their mean and covariance, again until every determinant
rests. Two fixed starts are followed (the quartiles' box and the unit sphere around the medians), and the quantile that
bounds the nearest share is approximate to 1/5000, as in deterministic forms of the method. All steps are joins and
aggregations, and groups are rows of a table, so neither their size nor their number is bounded.
A document is rejected when its squared Mahalanobis distance from its group's estimate is beyond a chi-squared quantile,
or when a base rule fails.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, releasing

#: Share of a group's documents that the estimate rests on, and the least documents of a group with an estimate of its own.
HELD_SHARE, LEAST_ROWS = 0.75, 200
#: Most steps of concentration, and the change of a log determinant that is rest.
STEPS, REST = 12, 0.02
#: Chance of a clean document to be rejected, were the statistics normal; theirs have longer tails.
ALPHA = 1e-9
#: Groups whose estimates are broadcast (about 1 kB each); more of them are joined by a shuffle.
MOST_BROADCAST = 20_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = ("f_chars", "f_symbols", "f_lines", "f_repeats", "f_upper", "f_marks")
#: Deviation that is added to each statistic's own.
FLOORS = (0.03, 0.03, 0.05, 0.05, 0.03, 0.03)
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"


def repeated(words: list[str], size: int = 3) -> int:
    """Words in windows of `size` words that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    code = a[:n]
    for j in range(1, size):
        code = code * len(ids) + a[j : n + j]
        if len(ids) ** (j + 1) > 1 << 40:
            code = np.unique(code, return_inverse=True)[1]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    hit = np.zeros(len(a), bool)
    for j in range(size):
        hit[j : n + j] |= twice
    return int(hit.sum())


def statistics(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x and not (x.isspace() and WORD.search(x) is None)]
    joined = "".join(words)
    upper = sum(map(str.isupper, joined)) if not joined.islower() else 0
    return (
        len(words), len(joined), sum(joined.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(words), len(lines), upper,
        sum(joined.count(c) for c in "!?"),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cols = list(zip(*map(statistics, batch.column("text").to_pylist()), strict=True))
            names = [x.split()[0] for x in _COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("group"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "grp", *names])


def _share(a: str, b: str) -> Column:
    """Angle of a share, whose sampling variance does not depend on the share."""
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))


def features(counted: DataFrame) -> DataFrame:
    return counted.withColumns({
        "f_chars": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), "f_symbols": _share("n_symbols", "word_chars"), "f_lines": _share("n_dup_lines", "n_lines"),
        "f_repeats": _share("n_repeat_words", "n_words"), "f_upper": _share("n_upper", "word_chars"), "f_marks": _share("n_marks", "word_chars"),
    })


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


class Estimate:
    """Centre and scatter of a group."""

    def __init__(self, centre: np.ndarray, scatter: np.ndarray):
        self.centre, self.scatter = centre, scatter + np.diag(np.square(FLOORS))
        self.precision = np.linalg.inv(self.scatter)
        self.log_det = float(np.linalg.slogdet(self.scatter)[1])

    def distances(self, x: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """What distance() gives for the rows of x, whose sampling variances are noise."""
        v = np.diag(self.scatter)
        z = (x - self.centre) * np.sqrt(v / (v + noise))
        return np.einsum("ni,ij,nj->n", z, self.precision, z)

    def row(self) -> dict:
        q = {f"q{i}_{j}": float(self.precision[i, j] * (2 if i < j else 1)) for i, j in _PAIRS}
        return {f"c{i}": float(self.centre[i]) for i in range(_P)} | {f"v{i}": float(self.scatter[i, i]) for i in range(_P)} | q | {"log_det": self.log_det}


_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
#: Centre, variances, and the terms of the quadratic form of the inverse scatter.
_FIELDS = [*(f"c{i}" for i in range(_P)), *(f"v{i}" for i in range(_P)), *(f"q{i}_{j}" for i, j in _PAIRS), "log_det"]
_ESTIMATE = f"struct<{', '.join(f'{f}: double' for f in _FIELDS)}>"


def noise() -> list[Column]:
    """Sampling variance of each statistic of a document, which short texts and few lines have more of."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return [0.25 / words, 1 / chars, 1 / lines, 3 / words, 1 / chars, 1 / chars]


def distances(rows: DataFrame, estimates: dict[str, str]) -> DataFrame:
    """rows with a squared distance (new name) from each estimate (its column): deviations shrink by the row's own noise beside the group's variance."""
    extra = noise()
    z = {f"_z_{d}_{i}": (F.col(f) - F.col(f"{e}.c{i}")) * F.sqrt(F.col(f"{e}.v{i}") / (F.col(f"{e}.v{i}") + extra[i])) for d, e in estimates.items() for i, f in enumerate(FEATURES)}
    form = {d: sum((F.col(f"_z_{d}_{i}") * F.col(f"_z_{d}_{j}") * F.col(f"{e}.q{i}_{j}") for i, j in _PAIRS), F.lit(0.0)) for d, e in estimates.items()}
    return rows.withColumns(z).withColumns(form).drop(*z)


def _moments(weight: Column, tag: str) -> list[Column]:
    out = [F.sum(weight).alias(f"{tag}n")]
    out += [F.sum(weight * F.col(FEATURES[i])).alias(f"{tag}s{i}") for i in range(_P)]
    return out + [F.sum(weight * F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"{tag}q{i}_{j}") for i in range(_P) for j in range(i, _P)]


def estimate_of(row: dict, tag: str, scale: float) -> Estimate | None:
    n = row[f"{tag}n"]
    if not n:
        return None
    centre = np.array([row[f"{tag}s{i}"] for i in range(_P)]) / n
    q = np.zeros((_P, _P))
    for i in range(_P):
        for j in range(i, _P):
            q[i, j] = q[j, i] = row[f"{tag}q{i}_{j}"] / n
    return Estimate(centre, (q - np.outer(centre, centre)) * scale)


def _estimates(f, tags: str):
    """A row of estimates of each row of sums; f(row, tag) gives one, or None to keep the old one (column e_<tag>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                got = {t: f(r, t) for t in tags}
                new = [e.row() if e else r[f"e_{t}"] for t, e in got.items()]
                moved = max((abs(n["log_det"] - r[f"e_{t}"]["log_det"]) if r.get(f"e_{t}") else 1.0) for n, t in zip(new, tags, strict=True))
                out.append({"unit": r["unit"], **{f"e_{t}": n for t, n in zip(tags, new, strict=True)}, "moved": moved})
            if out:
                kind = pa.struct([(f, pa.float64()) for f in _FIELDS])
                yield pa.RecordBatch.from_pylist(out, pa.schema([("unit", pa.string()), *((f"e_{t}", kind) for t in tags), ("moved", pa.float64())]))

    return run


def _with(rows: DataFrame, few: DataFrame, key: str, n: int) -> DataFrame:
    """rows with what few (one row per key, n in all) says; broadcast below a bound, else joined by keys that adaptive execution may split."""
    return rows.join(F.broadcast(few) if n <= MOST_BROADCAST else few.hint("merge"), key)


def minimum_covariance(rows: DataFrame, share: float = HELD_SHARE, steps: int = STEPS) -> DataFrame:
    """unit, estimate of each unit of rows (unit, the counts and the features); of the two starts the smaller determinant wins."""

    def start(r: dict, tag: str) -> Estimate:
        low, mid, high = (np.array([r[f][i] for f in FEATURES]) for i in range(3))
        return Estimate(mid, np.diag(((high - low) / 1.349) ** 2) if tag == "a" else np.eye(_P))

    kinds = lambda tags: "unit string, " + "".join(f"e_{t} {_ESTIMATE}, " for t in tags) + "moved double"
    quartiles = rows.groupBy("unit").agg(*(F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f) for f in FEATURES))
    now = cut(quartiles.mapInArrow(_estimates(start, "ab"), kinds("ab")), "mcd")
    units = now.count()
    # the mean over the nearest share falls short of the whole scatter by a known factor
    scale = share / chi2_cdf(chi2_quantile(share, _P), _P + 2)
    for _ in range(steps):
        d = distances(_with(rows, now.select("unit", "e_a", "e_b"), "unit", units), {"d_a": "e_a", "d_b": "e_b"}).drop("e_a", "e_b")
        limits = cut(d.groupBy("unit").agg(*(F.percentile_approx(f"d_{t}", share, 5000).alias(f"m_{t}") for t in "ab")), "mcd-limits")
        near = _with(d, limits, "unit", units)
        sums = near.groupBy("unit").agg(*(c for t in "ab" for c in _moments((F.col(f"d_{t}") <= F.col(f"m_{t}")).cast("double"), t)))
        now = cut(sums.join(now.drop("moved"), "unit").mapInArrow(_estimates(lambda r, t: estimate_of(r, t, scale), "ab"), kinds("ab")), "mcd")
        if (now.agg(F.max("moved")).first()[0] or 0.0) < REST:
            break
    # one step more from the better start, over all but far rows
    better = now.select("unit", F.when(F.col("e_a.log_det") <= F.col("e_b.log_det"), F.col("e_a")).otherwise(F.col("e_b")).alias("e_a"))
    far = chi2_quantile(0.975, _P)
    last = 0.975 / chi2_cdf(far, _P + 2)
    d = distances(_with(rows, better, "unit", units), {"d": "e_a"}).drop("e_a")
    sums = d.groupBy("unit").agg(*_moments((F.col("d") <= far).cast("double"), "a"))
    done = sums.join(better, "unit").mapInArrow(_estimates(lambda r, t: estimate_of(r, t, last), "a"), kinds("a"))
    return cut(done.select("unit", F.col("e_a").alias("estimate")), "mcd-done")


def quality_rules(docs: DataFrame, least_words: int = 50, most_repeats: int = 50, alpha: float = ALPHA, share: float = HELD_SHARE, least_rows: int = LEAST_ROWS, steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared, null where no group).

    base_failed: fewer than least_words words, or more than most_repeats percent of the words in repeated 3-word windows.
    A document is rejected beyond the chi-squared quantile of 1 - alpha. The estimates rest on the documents that pass the
    base rules. A language and source of fewer than least_rows such documents uses the language's estimate, then that of
    all; where even that is too small, the base rules decide alone.
    Nulls: a null text has no words; null lang or source are values of their own; a row with a null doc_id is left out.
    Repeated rows count each, and ties at a limit are all within it. Texts are counted whole, whatever their length. Other
    columns are not read. An empty table gives no rows.
    """
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    d = documents(docs, tag("lang").alias("lang"), tag("source").alias("source")).withColumn("group", F.concat_ws("\x1f", "lang", "source"))
    rows = features(d.select("doc_id", "group", "text").mapInArrow(releasing(_count), f"doc_id long, grp string, {_COUNTS}"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words")))
    rows = cut(rows, "quality-counts")
    # a row per group: the unit whose estimate judges it, and the units that its documents count for
    groups = rows.groupBy("grp").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")).withColumn("lang", F.substring_index("grp", "\x1f", 1))
    by_lang = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    every = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))
    own, of_lang, of_all = F.concat(F.lit("own "), "grp"), F.concat(F.lit("lang "), "lang"), F.lit("all")
    unit = F.when(F.col("n") >= least_rows, own).when(F.col("n_lang") >= least_rows, of_lang).when(F.col("n_all") >= least_rows, of_all)
    groups = cut(groups.join(by_lang, "lang").join(F.broadcast(every), how="cross").withColumn("unit", unit), "quality-groups")  # every: one row
    used = groups.where(F.col("unit").isNotNull()).select(F.col("unit").alias("used")).distinct()
    counted = groups.select("grp", F.explode(F.array(own, of_lang, of_all)).alias("used")).join(used, "used").withColumnRenamed("used", "unit")
    n_groups = groups.count()
    fit = _with(rows.where(~F.col("base_failed")), counted, "grp", 3 * n_groups)
    estimates = minimum_covariance(cut(fit.select("unit", *FEATURES, "n_words", "word_chars", "n_lines"), "quality-fit"), share, steps)
    judged = groups.select("grp", "unit").join(estimates, "unit", "left").select("grp", "estimate")
    cutoff = chi2_quantile(1 - alpha, _P)
    out = distances(_with(rows, judged, "grp", n_groups), {"distance": "estimate"})  # null without an estimate
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
