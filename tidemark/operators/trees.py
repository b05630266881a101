"""Pages as tables of nodes: one parse a page, and then joins. Steps, paths and subtree sums are equi-joins and windows of a page.

A node has its number in document order (pre) and the last number below it (last), so that a descendant's number lies between
the two; parent is the parent's number, -1 at the top. Text nodes have no tag.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dom
from ..functions.batches import bound
from .shared import new_folder

_NODE = "pre: int, last: int, parent: int, depth: int, tag: string, nth: int, twins: int, attrs: map<string,string>, text: string, text_bytes: int, own_bytes: int, skipped: boolean"


def _nodes(html: str) -> Iterator[tuple]:
    """Rows of a page's nodes; own_bytes are those of a node's tags or written text, without what is below."""
    doc = dom.parse(html or "")
    stack = [(c, -1, 0, i, t, False) for c, i, t in reversed(_places(doc))]
    rows: list[list] = []
    while stack:
        n, parent, depth, nth, twins, skipped = stack.pop()
        if n is None:
            rows[parent][1] = len(rows) - 1
            continue
        pre, below = len(rows), skipped or n.tag in dom.SKIPPED
        if n.tag is None:
            rows.append([pre, pre, parent, depth, None, nth, twins, {}, n.data, dom.bytes_of(n.data.strip()), dom.bytes_of(dom._shown(n)), skipped])
            continue
        a, b = dom._tags(n)
        rows.append([pre, pre, parent, depth, n.tag, nth, twins, dict(reversed(n.attrs)), None, 0, dom.bytes_of(a) + dom.bytes_of(b), skipped])
        stack.append((None, pre, 0, 0, 0, False))
        if n.tag not in dom.VOID:
            stack.extend((c, pre, depth + 1, i, t, below) for c, i, t in reversed(_places(n)))
    yield from map(tuple, rows)


def _places(n: dom.Node) -> list[tuple[dom.Node, int, int]]:
    """A node's children, which of its tag each is, and how many there are of that tag."""
    many, seen, out = Counter(c.tag for c in n.children), Counter(), []
    for c in n.children:
        seen[c.tag] += 1
        out.append((c, seen[c.tag], many[c.tag]))
    return out


def node_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and a row for each node of each page. A null page has no nodes; rows that repeat a key are pages of their own only with keys of their own."""

    @F.pandas_udf(f"array<struct<{_NODE}>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [] if h is None else list(_nodes(h)))

    bound(pages.sparkSession)
    return pages.select(F.col(key).alias("page"), F.explode(run(F.col(html))).alias("n")).select(F.col("page").alias(key), "n.*")


def children(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """nodes whose parent is one of the rows (key, pre) of `of`."""
    return nodes.join(of.select(key, F.col("pre").alias("parent")).distinct(), [key, "parent"], "left_semi").select(*nodes.columns)


def descendants(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """nodes below one of the rows (key, pre, last) of `of`.

    Those rows are reduced to intervals that do not overlap, and the last interval that begins before a node tells: a
    window over a page's nodes and intervals, in place of their pairs.
    """
    mark = F.max(F.col("last")).over(Window.partitionBy(key).orderBy("pre", "kind").rowsBetween(Window.unboundedPreceding, 0))
    both = nodes.select(key, "pre", F.lit(0).alias("kind"), F.lit(-1).alias("last")).unionByName(of.select(key, "pre", F.lit(1).alias("kind"), "last"))
    # an interval's own row comes after the node it begins at, which is not below itself
    inside = both.withColumn("reach", mark).where((F.col("kind") == 0) & (F.col("reach") >= F.col("pre"))).select(key, "pre")
    return nodes.join(inside, [key, "pre"], "left_semi").select(*nodes.columns)


_STEP = re.compile(r"(//?)([A-Za-z][\w-]*|\*)(?:\[(\d+)\]|\[@([\w-]+)(?:=['\"]([^'\"]*)['\"])?\])?")


def _test(tag: str, nth: str | None, attr: str | None, value: str | None) -> Column:
    out = F.col("tag").isNotNull() if tag == "*" else F.col("tag") == tag.lower()
    if nth:
        out = out & (F.col("nth") == int(nth))
    if attr:
        out = out & (F.col("attrs")[attr] == value if value is not None else F.col("attrs")[attr].isNotNull())
    return out


def select(nodes: DataFrame, path: str, key: str = "page_id") -> DataFrame:
    """nodes that a path of child (/) and descendant (//) steps leads to, each with a tag or *, and an index or an attribute in brackets."""
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"cannot read the path at {at}")
        steps.append(m)
        at = m.end()
    found: DataFrame | None = None
    for m in steps:
        if found is None:
            near = nodes if m[1] == "//" else nodes.where("parent = -1")
        else:
            near = descendants(nodes, found, key) if m[1] == "//" else children(nodes, found, key)
        found = near.where(_test(*m.groups()[1:]))
    return nodes.limit(0) if found is None else found


def paths(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pre, xpath of elements: an index stands only among several siblings of a tag.

    Pointers double: after each round a row's path reaches twice as far up, so a page of depth d takes log2(d) rounds of
    one equi-join, each written to the shared folder.
    """
    spark = nodes.sparkSession
    one = F.concat(F.lit("/"), F.col("tag"), F.when(F.col("twins") > 1, F.concat(F.lit("["), "nth", F.lit("]"))).otherwise(F.lit("")))
    now = nodes.where("tag IS NOT NULL").select(key, "pre", F.col("parent").alias("up"), one.alias("xpath"))
    while True:
        path = new_folder(spark, "paths")
        now.write.parquet(path)
        now = spark.read.parquet(path)
        if now.where("up >= 0").isEmpty():
            return now.select(key, "pre", "xpath")
        above = now.select(key, F.col("pre").alias("up"), F.col("up").alias("over"), F.col("xpath").alias("before"))
        now = now.join(above, [key, "up"], "left").select(key, "pre", F.coalesce("over", F.lit(-1)).alias("up"), F.concat(F.coalesce("before", F.lit("")), "xpath").alias("xpath"))


def subtree_sums(nodes: DataFrame, key: str = "page_id", **measures: Column) -> DataFrame:
    """key, pre and, for each node, the sums of the measures over itself and all below: differences of running sums, found by the last number below."""
    run = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.select(key, "pre", "last", *(m.cast("long").alias(n) for n, m in measures.items()))
    own = own.select("*", *(F.sum(n).over(run).alias(f"_{n}") for n in measures))
    end = own.select(key, F.col("pre").alias("last"), *(F.col(f"_{n}").alias(f"_to_{n}") for n in measures))
    return own.join(end, [key, "last"]).select(key, "pre", *((F.col(f"_to_{n}") - F.col(f"_{n}") + F.col(n)).alias(n) for n in measures))


def densities(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, xpath, density of the children of each page's first body: the share of text (not of scripts and styles) in their bytes."""
    first = nodes.where("tag = 'body'").groupBy(key).agg(F.min("pre").alias("pre"))
    kids = children(nodes, first, key).where("tag IS NOT NULL").select(key, "pre", "last")
    below = nodes.join(kids.select(key, F.col("pre").alias("top"), F.col("last").alias("end")), key).where("pre BETWEEN top AND end")  # a page's body has few children
    sums = below.groupBy(key, "top").agg(F.sum(F.when(F.col("skipped"), 0).otherwise(F.col("text_bytes"))).alias("text"), F.sum("own_bytes").alias("all"))
    sums = sums.where(F.greatest("text", "all") > 0).select(key, F.col("top").alias("pre"), F.round(F.col("text") / F.greatest("text", "all"), 3).alias("density"))
    return sums.join(paths(nodes, key), [key, "pre"]).select(key, "xpath", "density")
