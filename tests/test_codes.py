"""Neighbours by codes against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import codes, vectors


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + list(extra), "vec_id long, embedding array<double>").repartition(4)


def test_recall_on_the_test_table(spark, sf_dir):
    q = __spark_entry__.queries()
    want = {(r["query"], r.vec_id): r.score for r in q["vector_neighbours"](spark, sf_dir).collect()}
    found = {(r["query"], r.vec_id): r.score for r in q["vector_codes"](spark, sf_dir).collect()}
    assert len(found.keys() & want.keys()) >= 0.9 * len(want)
    assert all(found[k] == want[k] for k in found.keys() & want.keys())


def test_clustered_vectors_need_few_cells_and_candidates(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 32)) * 2)[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32)) * 0.4
    df = frame(spark, x, [(9000, None), (9001, [1.0]), (None, [0.0] * 32), (9002, [0.0] * 32)])
    coder = codes.fit_codes(df, k=10)
    assert len(coder.centres) == 55 and coder.probes <= 12
    index = codes.encoded(df, coder).cache()
    assert sum(len(r.ids) // 8 for r in index.collect()) == 3001
    asked = df.where("vec_id % 50 = 0")
    got = codes.near_by_codes(index, df, asked, coder, 10)
    want = {(r["query"], r.vec_id) for r in vectors.neighbours(df.where("size(embedding) = 32 AND vec_id IS NOT NULL"), asked.where("vec_id < 3000"), 10).collect()}
    found = {(r["query"], r.vec_id) for r in got.where("query < 3000").collect()}
    assert len(found & want) >= 0.93 * len(want)
    assert codes.candidates(index, asked, coder, 10).count() < 0.08 * 61 * 3000
    size = index.agg(F.sum(sum(F.octet_length(c) for c in ("ids", "codes", "steps", "errors")))).first()[0]
    assert size < 0.25 * 3001 * (8 + 8 * 32)


def test_codes_are_within_their_errors():
    rng = np.random.default_rng(1)
    for dim in (1, 7, 32):
        x = rng.normal(size=(200, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        coder = codes.Coder(x[:5], np.linalg.qr(rng.normal(size=(dim, dim)))[0], 2)
        cell = coder.cells(x)[:, 0]
        code, step, error = coder.encode(x, cell)
        back = coder.decode(code, step) @ coder.turn + x[:5][cell]
        assert np.allclose(np.linalg.norm(back - x, axis=1), error, atol=1e-6) and error.max() < 0.5


def test_an_empty_table(spark):
    with pytest.raises(ValueError):
        codes.fit_codes(frame(spark, []))


def test_a_query_goes_to_a_group_of_cells_once(spark):
    x = np.random.default_rng(2).normal(size=(600, 8))
    coder = codes.Coder(x[:300], np.eye(8), 280)
    got = codes.asked_cells(frame(spark, x), coder).collect()
    sent = [(r.part, i) for r in got for i in np.frombuffer(r.own, "<i8")]
    assert len(sent) == len(set(sent)) <= codes.GROUPS * 600 < 280 * 600
    assert sum(np.frombuffer(r.hits, bool).sum() for r in got) == 280 * 600


def test_tasks_without_rows_and_odd_vectors(spark):
    x = np.random.default_rng(6).normal(size=(300, 8))
    odd = [(1000, [float("nan")] + [1.0] * 7), (1050, [None] + [1.0] * 7), (1100, [float("inf")] + [1.0] * 7), (1150, [1.0] * 9), (1200, []), (1250, None)]
    sc, good = spark.sparkContext, frame(spark, x)
    parts = [sc.parallelize([(r.vec_id, r.embedding) for r in good.collect()] + odd, 2), sc.parallelize([], 2)]
    df = spark.createDataFrame(sc.union(parts), good.schema)
    coder = codes.fit_codes(df, k=5)
    assert coder.turn.shape == (8, 8) and len(coder.centres) == 18 and np.isfinite(coder.centres).all()
    index = codes.encoded(df, coder).withColumn("cell", F.col("cell").cast("string")).cache()
    assert sum(len(r.ids) // 8 for r in index.collect()) == 300
    found = {(r["query"], r.vec_id) for r in codes.near_by_codes(index, df, df.where("vec_id % 50 = 0"), coder, 5).collect()}
    want = {(r["query"], r.vec_id) for r in vectors.neighbours(good, good.where("vec_id % 50 = 0"), 5).collect()}
    assert len(found) == len(want) == 30 and len(found & want) >= 27
