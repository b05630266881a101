import math
import random
from collections import defaultdict

import pytest

from tidemark.llm.mixing import Sums, entropy, find_exponent, mix, weights


def sums(spark, tokens):
    return Sums(spark.createDataFrame([(str(i), float(t)) for i, t in enumerate(tokens)], "source_key string, tokens double"))


def test_exponent_meets_its_targets(spark):
    tokens = [900.0, 70.0, 20.0, 10.0]
    s = sums(spark, tokens)
    for share in (0.5, 0.8, 0.99):
        a = find_exponent(s, target_entropy_share=share)
        assert entropy(weights(tokens, a)) == pytest.approx(share * math.log(4), abs=1e-6)
    a = find_exponent(s, repetition_limit=3.0)
    w = weights(tokens, a)
    assert max(x * 1000 / t for x, t in zip(w, tokens)) == pytest.approx(3.0, abs=1e-6)
    assert find_exponent(s, repetition_limit=1e9) == 0.0 and find_exponent(sums(spark, []), 1.0) == 0.0
    assert find_exponent(s, target_entropy_share=0.0) == 1.0
    assert sum(w) == pytest.approx(1)


def frame(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 40), "big" if i % 3 else rng.choice(["a", "b", "c"]), 1.0) for i in range(1500)]
    rows += [(9001, None, "a", 1.0), (9002, "x y", None, 1.0), (None, "x", "a", 1.0), (9003, "", "empty", 1.0), (9004, "tie", "a", 2.0), (9004, "tie", "a", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang double"), rows


def exponent(tokens, holds):
    """Plain bisection over the weights."""
    low, high = 0.0, 1.0
    if holds(weights(tokens, 0.0)):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(weights(tokens, mid)) else (mid, high)
    return high


def test_budget_and_passes(spark):
    df, rows = frame(spark)
    tokens, docs = defaultdict(int), defaultdict(list)
    for d, t, s, _ in rows:
        if d is not None:
            tokens[s] += len((t or "").split())
            docs[s].append((d, len((t or "").split())))
    budget = 2 * sum(tokens.values())
    got = mix(df, target_entropy_share=0.9, repetition_limit=6.0, budget=budget, blocks=16).collect()
    alive = [n for n in sorted(tokens, key=str) if tokens[n]]
    amounts = [float(tokens[n]) for n in alive]

    def holds(w):
        h = -sum(x * math.log(x) for x in w)
        return h <= 0.9 * math.log(len(w)) and max(x * budget / t for x, t in zip(w, amounts, strict=True)) <= 6

    w = dict(zip(alive, weights(amounts, exponent(amounts, holds)), strict=True))
    used, times = defaultdict(int), defaultdict(lambda: defaultdict(int))
    passes = defaultdict(lambda: defaultdict(dict))
    size = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for r in got:
        assert r.weight == pytest.approx(w.get(r.source, 0.0), abs=1e-7)
        used[r.source] += r.n_tokens
        times[r.source][r.doc_id] += 1
        passes[r.source][r.epoch][r.doc_id] = r.block_rank
        size[r.source][r.epoch][r.block_rank] += r.n_tokens
        assert 0 <= r.progress <= 1
    for n in alive:
        assert budget * w[n] - 80 <= used[n] <= budget * w[n] + 1e-3
        whole = int(budget * w[n] / tokens[n] + 1e-7)
        for d, _ in docs[n]:
            c = times[n][d] // sum(1 for x, _ in docs[n] if x == d)
            assert c in (whole, whole + 1)
        for r in got:  # a block starts where those before it in its pass end
            if r.source == n:
                before = sum(v for k, v in size[n][r.epoch].items() if k < r.block_rank)
                assert r.progress == pytest.approx(min(1, (r.epoch + before / tokens[n]) / (budget * w[n] / tokens[n])), abs=1e-6)
        for epoch, ranks in passes[n].items():
            if epoch < whole:  # a whole pass holds every document, and its ranks are a permutation of blocks
                assert set(ranks) == {d for d, _ in docs[n]} and set(ranks.values()) == set(range(1, len(set(ranks.values())) + 1))
    # documents of one block stay together, and each pass has an order of its own
    first, second = passes["c"][0], passes["c"][1]
    groups = lambda p: {frozenset(d for d in p if p[d] == r) for r in set(p.values())}
    assert groups(first) == groups(second) and first != second
    turned = {(second[d] - first[d]) % 16 for d in first}
    assert len(turned) > 1  # not the same order begun elsewhere
    assert times["empty"][9003] == 1


def test_cover_keeps_every_document(spark):
    df, rows = frame(spark)
    got = mix(df, repetition_limit=1.5, cover=True, blocks=16, carry=("text", "lang")).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in rows if d is not None}
    assert max(r.epoch for r in got) == 1
    assert got[0].asDict().keys() >= {"text", "lang"}


def test_many_sources(spark):
    from pyspark.sql import functions as F

    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 60_000, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("source"))
    got = mix(df, target_entropy_share=0.999, blocks=4)
    n, tokens = got.agg(F.count("*"), F.sum("n_tokens")).first()
    assert n > 100_000 and tokens <= 400_000
    assert got.where("source = 'hot'").count() < 60_000


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string"), target_entropy_share=0.9).collect() == []
