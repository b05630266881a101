import math

import numpy as np
import pytest

from tidemark.llm import hard_negatives as module
from tidemark.llm.hard_negatives import Best, _Side, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label long, score double, rank string, ids int"


def brute(rows, every=10, positives=5, negatives=10):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [max(-(1 << 22), min(1 << 22, math.floor(256 * x))) for x in v]
        kept[i] = min(kept.get(i, (label, x)), (label, x))
    dim = max((len(x) for _, x in kept.values()), default=0)
    kept = {i: (label, x + [0] * (dim - len(x))) for i, (label, x) in kept.items()}
    out = []
    for a, (la, va) in kept.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(va, v, strict=True)) for i, (_, v) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == la][:positives]:
            near = [i for i in order if kept[i][0] != la and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(near[:negatives], 1)]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), [float(x) for x in (centres[i % 6] + 0.4 * rng.normal(size=12)) * (0.2 if i % 11 else 0)], int(i % 4 if i % 3 else 1)) for i in range(-60, 340)]
    rows += [(1000 + i, [0.5] * 12, i % 2) for i in range(40)]  # ties
    same = [0.25] * 11 + [-0.125]
    rows += [(2000, same, 7), (2000, same, 7), (2001, same, 7), (2001, [0.1] * 12, 8), (2010, [], 1), (2020, [1.0] * 15, 2), (2030, [1e9, -1e300] + [0.0] * 10, 3), (2040, same, 99)]
    rows += [(None, same, 1), (3000, None, 1), (3001, same, None), (3002, [None] * 12, 1), (3003, [float("nan")] * 12, 1), (3004, [float("inf")] + same[1:], 1), (3010, [float("-inf")] + same[1:], 1)]
    return [(*r, 0.5, "x", 1) for r in rows]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many packs and groups of them
        for name, value in (("PACK_NUMBERS", 64), ("ROW_PACKS", 2), ("ANCHOR_PACKS", 1), ("_SURVIVORS", 50)):
            monkeypatch.setattr(module, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives(df, anchor_every=10, leading=3)
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1, 0.0, "", 0)], [(0, [1.0], 1, 0.0, "", 0), (1, [1.0], 2, 0.0, "", 0)]])
def test_nothing_to_find(spark, rows):
    assert hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_bounds_discard_most_pairs():
    """Few pairs of clustered vectors are verified, and the best are those of all integer products."""
    rng = np.random.default_rng(3)
    v = (256 * (rng.normal(size=(40, 64)) * 2 / np.arange(1, 65))[rng.integers(0, 40, 5000)] + 8 * rng.normal(size=(5000, 64))).astype("<i4")
    axes = np.ascontiguousarray(np.linalg.eigh(v.T.astype(float) @ v)[1][:, ::-1])
    pack = lambda at: _Side({"ids": at.astype("<i8").tobytes(), "labels": np.zeros(len(at), "<i8").tobytes(), "vectors": v[at].tobytes()}, 64, axes, [16, 32])
    a, r = pack(np.arange(50)), pack(np.arange(5000))
    best = Best(a, np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62), 5, True, [16, 32])
    for b in range(0, 5000, 500):
        best.meet(r, slice(b, b + 500), 64 * 2.0**-46)
    exact = v[:50].astype(np.int64) @ v.T.astype(np.int64)
    exact[np.arange(50), np.arange(50)] = -(1 << 62)
    assert (best.id == np.lexsort((np.arange(5000)[None].repeat(50, 0), -exact))[:, :5]).all()
    assert best.verified < 0.35 * exact.size
