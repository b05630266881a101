"""The index of segments against ranking by the texts, over changes, deletions and merges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, segments
from tidemark.operators.search import QueryError
from tidemark.operators.segments import Segments

COLUMNS = ("title", "text")


def made(seed, ids):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(40)] + ["lad", "ladder", "élan", "東京", "x1"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 200])))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, text string")


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """An index after two inserts, a change of some rows, and deletions; its rows; its folder."""
    path = str(tmp_path_factory.mktemp("index"))
    index = Segments(spark, f"file://{path}", "id", COLUMNS, buckets=8, block=16)
    rows = {r[0]: r for r in made(1, range(300))} | {r[0]: r for r in made(2, range(500, 700))}
    index.change(frame(spark, [r for i, r in rows.items() if i < 400]))
    index.change(frame(spark, [(None, "no", "key"), *(r for i, r in rows.items() if i >= 400)]))
    whole, new = size(path), made(3, range(290, 300)) + [(900, None, None), (901, "", "the the")]
    index.change(frame(spark, new), frame(spark, [(i, "", "") for i in (5, 6, 501, 12345)]).select("id"))
    rows |= {r[0]: r for r in new}
    index.change(deleted=frame(spark, [(7, "", "")]).select("id"))
    for i in (5, 6, 501, 7):
        del rows[i]
    return index, list(rows.values()), path, (whole, size(path))


QUERIES = ["the of", "w1 OR w2 OR the", "the NOT w3", '"of the" OR lad*', "title:the w5", "lad*", '"the of" the', "élan 東京", "missing", "the AND (w7 OR w8) NOT lad*"]


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_are_those_of_the_texts(spark, changed, query):
    index, rows, *_ = changed
    for limit in (None, 5):
        want = search.bm25(frame(spark, rows), query, "id", COLUMNS, limit=None).withColumn("rank", F.round("rank", 9)).collect()
        want = sorted(map(tuple, want), key=lambda r: (r[1], r[0]))[:limit]
        got = sorted(((r.id, round(r["rank"], 9)) for r in index.ranked(query, limit).collect()), key=lambda r: (r[1], r[0]))
        assert got == want


def test_a_change_writes_what_it_changes(changed):
    _, _, _, (before, after) = changed
    assert after - before < 0.45 * before  # twelve of five hundred rows, in files of their own


def test_merges_keep_the_answers(spark, changed):
    index, rows, *_ = changed
    want = sorted(map(tuple, search.vocabulary(frame(spark, rows).select("id", F.concat_ws(" ", *COLUMNS).alias("t")), "id", "t").collect()))
    assert sorted(map(tuple, index.vocabulary().collect())) == want
    best = [tuple(r) for r in index.ranked("the of", 10).collect()]
    index.change(frame(spark, []))
    for i in (1, 2):  # two more changes of the size of the first small one
        index.change(frame(spark, [r for r in rows if r[0] >= 290][i * 11 : i * 11 + 11]))
    n = len(index.state()[0])
    assert index.merge(fan=3) and len(index.state()[0]) < n
    assert sorted(map(tuple, index.vocabulary().collect())) == want
    assert [tuple(r) for r in index.ranked("the of", 10).collect()] == best
    # the dictionary still counts deleted documents of segments that have not been merged
    known = {r[0]: r[1] for r in index.prefixed("lad").groupBy("term").agg(F.sum("documents")).collect()}
    assert known.keys() == {t for t, *_ in want if t.startswith("lad")} and all(known[t] >= n for t, n, _ in want if t in known)


def test_a_broken_change_is_not_seen(spark, tmp_path, monkeypatch):
    index = Segments(spark, f"file://{tmp_path}", "id", COLUMNS, buckets=4, block=16)
    index.change(frame(spark, made(1, range(20))))
    before = index.documents().count(), index.ranked("the").count()
    monkeypatch.setattr(Segments, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.change(frame(spark, made(2, range(10, 30))))
    assert (index.documents().count(), index.ranked("the").count()) == before
    monkeypatch.undo()
    index.change(frame(spark, made(2, range(10, 30))))
    assert index.documents().count() == 30


def test_most_postings_are_skipped(spark, tmp_path):
    """Of a word that every document has, the blocks of long documents cannot reach the best scores."""
    index = Segments(spark, f"file://{tmp_path}", "id", ("text",), buckets=4, block=16)
    docs = spark.range(4000).select("id", F.concat(F.lit("the "), F.repeat(F.lit("word "), (F.col("id") % 997 + 1).cast("int"))).alias("text"))
    index.change(docs)
    told = {}
    got = [(r.id, round(r["rank"], 12)) for r in index.ranked("the", 10, told).collect()]
    want = search.bm25(docs, "the", "id", ("text",), limit=10).collect()
    assert got == [(r.id, round(r["rank"], 12)) for r in want]
    assert told["postings"] == 4000 and told["read"] + told["first"] < 1000


def test_a_prefix_reads_one_partition_of_the_dictionary(spark, changed):
    index, *_ = changed
    plan = index.prefixed("lad")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "head" in plan.split("PartitionFilters")[1][:120]
    assert "GreaterThanOrEqual(term,lad)" in plan or "StringStartsWith(term,lad)" in plan


def test_refusals_and_an_empty_index(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}", "id", COLUMNS, buckets=4, block=16)
    index.change(frame(spark, []))
    assert index.ranked("the").collect() == [] and index.vocabulary().collect() == [] and index.prefixed("a").collect() == []
    for bad in ("NEAR(a b)", "body:x", ""):
        with pytest.raises(QueryError):
            index.ranked(bad).collect()
    assert segments.FIRST > 0


def test_rows_that_repeat_a_key_are_documents_of_their_own(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}", "id", ("text",), buckets=4, block=16)
    index.change(spark.createDataFrame([(1, "a a b"), (1, "a c"), (2, "c")], "id long, text string"))
    assert index.documents().count() == 3
    assert sorted(map(tuple, index.vocabulary().collect())) == [("a", 2, 3), ("b", 1, 1), ("c", 2, 2)]


def test_ranges_are_merged_whole(spark, tmp_path, monkeypatch):
    """Small ranges are put together, up to the block; a long document keeps a range of its own; deleted documents leave theirs."""
    monkeypatch.setattr(segments, "LONG", 50)
    index = Segments(spark, f"file://{tmp_path}", "id", ("text",), buckets=4, block=16)
    for k in range(3):
        index.change(spark.range(k * 4, k * 4 + 4).select("id", F.concat(F.lit("all x"), F.col("id"), F.when(F.col("id") % 4 == 3, F.repeat(F.lit(" word"), 60)).otherwise("")).alias("text")), spark.range(1))
    assert index.merge(fan=3) and not list(tmp_path.glob("texts/segment*")) and not list(tmp_path.glob("ranges/segment*"))
    ranges = {}
    for r in index.documents().collect():
        ranges.setdefault(r.range, []).append(r.doc)
    assert all(len(x) == 1 or not {3, 7, 11} & set(x) for x in ranges.values()) and all(len(x) <= 16 for x in ranges.values())
    blocks = index._read("postings", index.state()[0]).where("term = 'all'").collect()
    assert sorted(d for b in blocks for d in b.docs) == list(range(1, 12)) and sum(b.n for b in blocks) == 11
    assert sorted(r.id for r in index.ranked("all", None).collect()) == list(range(1, 12))
