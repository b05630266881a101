import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.exact_dedup import LsmIndex, Run, exact_dedup


def test_index_against_a_dictionary():
    rng = random.Random(1)
    for largest in (False, True):
        index, want = LsmIndex(8, largest, memtable_rows=7, fanout=3), {}
        for _ in range(60):
            keys = [rng.randrange(90).to_bytes(8, "big") for _ in range(5)]
            ids = np.array([rng.randrange(-99, 99) for _ in keys])
            index.add(keys, ids, np.ones(5, np.int64))
            for k, i in zip(keys, ids.tolist(), strict=True):
                b, n = want.get(k, (i, 0))
                want[k] = ((max if largest else min)(b, i), n + 1)
        every = [i.to_bytes(8, "big") for i in range(120)]
        best, count = index.get(every)
        for k, b, n in zip(every, best.tolist(), count.tolist(), strict=True):
            assert want.get(k, (0, 0)) == (b, n)
        rest = index.rest()
        assert rest.digests.tolist() == sorted(x.rstrip(b"\0") for x in want) or len(rest.digests) == len(want)
        assert sum(len(level) for level in index.levels) < 20


def test_filter_has_no_false_negatives():
    keys = np.array(sorted(hashlib.sha256(bytes([i])).digest() for i in range(200)), "S32")
    run = Run(keys, np.arange(200), np.ones(200, np.int64))
    assert run.find(keys).tolist() == list(range(200))


def brute(rows, largest):
    out = []
    for d, t in rows:
        ids = [x for x, u in rows if (u or "") == (t or "")]
        keep = (max if largest else min)(ids)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("keep", "bits"), [("largest", 256), ("smallest", 256), ("largest", 8)])
def test_against_brute_force(spark, keep, bits):
    rng = random.Random(3)
    texts = [f"text {i} " * rng.randint(1, 5) for i in range(60)] + ["", None, "ß" * 50_000]
    rows = [(i * 3 - 40, rng.choice(texts)) for i in range(150)] + [(5, "same"), (5, "same")]
    df = spark.createDataFrame([(d, t, 9, None) for d, t in rows], "doc_id long, text string, keep_id int, digest string").repartition(3)
    got = sorted(tuple(r) for r in exact_dedup(df, keep=keep, digest_bits=bits, memtable_rows=16).collect())
    assert got == brute(rows, keep == "largest")


def test_edges(spark):
    schema = "doc_id long, text string, lang string"
    assert exact_dedup(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, "a", None), (2, "A", None), (3, "a", "x")], schema)
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in exact_dedup(df, normalise=F.lower, carry=("text", "lang")).collect()}
    assert set(got) == {2, 3} and got[3].keep_id == 2 and got[2].text == "A" and got[3].lang == "x"


def test_large_groups_are_split_and_small_tasks_write_out(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(400)] + [(7, "hot"), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup(df, keep="largest", memtable_rows=8, held_rows=20, hot_rows=25).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, True)


def test_only_hits_are_shuffled_with_their_texts(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    plan = exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filter_of_hits():
    from tidemark.llm.exact_dedup import Bloom, _with_id

    d = np.array([hashlib.sha256(bytes([i])).digest() for i in range(200)], "S32")
    f = Bloom(2000)
    f.add(d[:100])
    assert f.test(d[:100]).all() and f.test(d[100:]).mean() < 0.1
    ids = np.arange(200)
    assert len(set(_with_id(d, ids).tolist())) == 200 and (_with_id(d, ids) != _with_id(d, ids + 1)).all()


def test_carried_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a", True)], "doc_id long, text string, kept boolean")
    with pytest.raises(ValueError, match="rename"):
        exact_dedup(df, carry=("Kept",))
