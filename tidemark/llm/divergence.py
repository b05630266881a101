"""Which sources of a language use words that others do not: exact divergences of sources and of terms, in joins and sums."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bound_batches, cut, releasing

SCALE = 1_000_000_000
#: A term is a longest run of ASCII letters and of what is not ASCII, A-Z lower-cased; every other byte is a blank here.
_UPPER, _OTHER = bytes(range(65, 91)), bytes([*range(65), *range(91, 97), *range(123, 128)])
_TABLE = bytes.maketrans(_UPPER + _OTHER, _UPPER.lower() + b" " * len(_OTHER))
#: Terms that a task counts before it hands their counts on.
_HELD = 300_000


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _counted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    rows: list[list] = [[], [], [], [], []]
    for (lang, source), (n, d) in held.items():
        for column, values in zip(rows, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *(d[t] for t in n)]), strict=True):
            column += values
    lang, source, term, n, d = rows
    cols = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "occurrences", "documents"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(text)
            n.update(terms)
            d.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > _HELD:
            yield _counted(held)
            held = {}
    if held:
        yield _counted(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, occurrences, documents of every term of every group; a group's own row has the term null.

    Tasks explode texts and sum up what they hold in Arrow batches, so that no row is made for each of a text's terms.
    """
    bound_batches(docs.sparkSession)
    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = filled.mapInArrow(releasing(_count), "lang string, source string, term string, occurrences long, documents long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in decimals: the product may be larger than a long."""
    d = lambda c: F.col(c).cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (d(count) + F.lit(1)).cast("decimal(20,0)"), (d(total) + d(kept)).cast("decimal(20,0)")) + F.lit(1)


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_divergence(docs: DataFrame, least_documents: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: a source's distances to the other sources of its language (part pair), and its telling terms (part term).

    A language keeps the terms that at least least_documents of its documents have. Every group (lang, source) and each
    language gives each kept term p = 1 + floor(1e9 * (count + 1) / (N + V)): count its occurrences there, N the sum of
    those over kept terms, V the number of kept terms. The value of p against q is floor((p - q)^2 / q). A pair has the sum
    over all kept terms, q the other source's; a term, which occurs in the group with p above the language's q, has its
    own, and the first most_terms of a group are returned. All arithmetic is exact (longs and decimals).
    Nulls in text, lang and source are ''; doc_id is not read, so every row is a document, repeated ones too. A group
    without terms takes part in pairs; a language without kept terms has pairs of value 0 and no terms; one with a single
    source has no pairs. Ties go by the item's UTF-8 bytes. An empty table gives no rows. A text of any length is one row's
    array of terms. Other columns are not read.
    """
    counts = cut(term_counts(docs), "sd-counts")
    terms = counts.where("term IS NOT NULL")
    by_lang = terms.groupBy("lang", "term").agg(F.sum("occurrences").alias("all"), F.sum("documents").alias("documents"))
    # numbers stand for kept terms and groups from here on, which the written tables hold
    kept = cut(by_lang.where(F.col("documents") >= least_documents).select("lang", "term", "all", F.monotonically_increasing_id().alias("t")), "sd-kept")
    used = cut(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "t", "all", "occurrences"), "sd-used")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_lang"))
    sums = used.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    groups = cut(groups.select("*", F.monotonically_increasing_id().alias("g")), "sd-groups")
    used = used.join(groups, ["lang", "source"])
    # every kept term of a language in each of its sources, with zeros where it does not occur
    dense = kept.select("lang", "t").join(groups.select("lang", "g", "n", "v"), "lang").join(used.select("t", "g", "occurrences"), ["t", "g"], "left").na.fill(0, ["occurrences"])
    dense = cut(dense.select("t", "g", _share("occurrences", "n", "v").alias("p")), "sd-dense")
    # both directions of two sources in one row
    both = dense.join(dense.select("t", F.col("g").alias("h"), F.col("p").alias("q")), "t").where("g < h").groupBy("g", "h").agg(F.sum(_gap("p", "q")).alias("there"), F.sum(_gap("q", "p")).alias("back"))
    apart = both.select("g", "h", F.col("there").alias("value")).unionByName(both.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))
    pairs = groups.select("lang", "source", "g").join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").where("g <> h")
    pairs = pairs.join(apart, ["g", "h"], "left").na.fill(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    told = used.where("occurrences > 0").select("lang", "source", F.col("term").alias("item"), _share("occurrences", "n", "v").alias("p"), _share("all", "n_lang", "v").alias("q"))
    told = told.where("p > q").select("lang", "source", "item", _gap("p", "q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(told.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
