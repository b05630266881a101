import random
import re

import numpy as np
import pytest

from tidemark.llm import near_dedup as module
from tidemark.llm.graph import components
from tidemark.llm.near_dedup import near_dedup, shingle_sets, signature


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, set_of(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(300)] + ["A", "Ü"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(1000 + i, " ".join(make(rng.randint(0, 60)))) for i in range(60)]
    for g in range(6):
        base = make(rng.choice([6, 8, 40, 120]))
        for i in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((g * 50 + i * 2 - 60, "  ".join(w) + rng.choice(["", "\n"])))
    chain = make(300)  # each is near the next one only
    rows += [(5000 - i, " ".join(chain[i * 4 : i * 4 + 80])) for i in range(50)]
    rows += [(7001, None), (7002, ""), (7003, " \n"), (7004, "one two"), (7005, "ONE  Two"), (None, "one two"), (7006, "x " * 20_000), (7007, "x " * 90)]
    return rows


@pytest.mark.parametrize("block", [1500, 6])
def test_against_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, text string, digest string, rep int").repartition(3)
    assert sorted(tuple(r) for r in near_dedup(df, block_docs=block).collect()) == brute(rows)


def test_sets_and_signatures():
    texts = [t or "" for _, t in corpus()]
    sets = shingle_sets([t.encode() for t in texts], 5)
    assert [len(s) for s in sets] == [len(set_of(t)) for t in texts]
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64))
    differ = np.mean([(signature(a[i : i + 700]) != signature(a[i + 100 : i + 800])).mean() for i in range(0, 3000, 50)])
    assert abs(differ - 0.25) < 0.03
    assert {x.tobytes() for x in shingle_sets([b"a b c", b"A  B\tc", b"a b"], 5)}.__len__() == 2


def test_keys_by_the_pigeonhole_principle():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (300, module.VALUES)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(module.VALUES, 2 * module.CHUNKS - 1, replace=False)
        row[at] += 1
    ka, kb = module.chunk_keys(a), module.chunk_keys(b)
    assert (ka == kb).any(axis=1).all()


def test_components_of_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (5, 4), (-3, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 301)} | {i: -3 for i in range(1000, 1200)}
    assert got == want
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), local_edges=150).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, lang string"
    assert near_dedup(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(3, "a b c d e f", None), (3, "p q r s t u", None), (1, "p q r s t u", "x")], schema)
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup(df, carry=("lang",)).collect()} == {(3, 1, False), (1, 1, True)}


def test_only_documents_of_one_key_are_compared(spark, monkeypatch):
    """A family of 20,000 chained documents, of which each shares a key with few: compared pairs follow the keys, not the family."""
    from pyspark.sql import functions as F

    n = 20_000
    keys = spark.range(n).select((F.col("id") * 10).alias("key"), F.explode(F.array("id", F.col("id") + 1, F.col("id") + 2)).alias("rep")).where(F.col("rep") < n)
    least = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("members"))
    met = keys.join(least, "key")
    classes = spark.range(n).select(F.col("id").alias("rep"), F.lit(10).cast("long").alias("n_shingles"))
    none = spark.createDataFrame([], "node long, root long")
    found = module.open_regions(met, classes, none, 600, 600_000)
    sizes = [r[0] for r in found.groupBy("region").count().select("count").collect()]
    assert max(sizes) == 3 and len(sizes) == n - 2
    assert sum(s * (s - 1) // 2 for s in sizes) < 4 * n
