import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import metric_join as module
from tidemark.llm import regions
from tidemark.llm.metric_join import bounds, chunk_keys, metric_join


def set_of(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [(d, set_of(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d == e or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed=11):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)] + ["A", "Ü"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(1000 + i, " ".join(make(rng.randint(0, 60)))) for i in range(60)]
    for g in range(7):
        base = make([6, 8, 20, 40, 90, 150, 300][g])
        for i in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((g * 50 + i * 2 - 60, "  ".join(w) + rng.choice(["", "\n"])))
    chain = make(400)  # each is near the next one only
    rows += [(5000 - i, " ".join(chain[i * 4 : i * 4 + 120])) for i in range(60)]
    passage = " ".join(make(40))
    rows += [(6000 + i, " ".join(make(rng.randint(5, 40))) + " " + passage) for i in range(40)]
    rows += [(7001, None), (7002, ""), (7003, " \n"), (7004, "one two"), (7005, "ONE  Two"), (None, "one two"), (7006, "x " * 20_000), (7007, "x " * 90), (7008, passage), (7008, passage)]
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, text string, digest string, rep int").repartition(3)
    return sorted(map(tuple, metric_join(df, **more).collect()))


@pytest.mark.parametrize("more", [{}, {"block_docs": 4}])
def test_against_brute_force(spark, more):
    rows = corpus()
    assert found(spark, rows, **more) == brute(rows)


def test_another_threshold(spark):
    rows = corpus(4)
    assert found(spark, rows, percent=60, block_docs=5) == brute(rows, 60)


def test_an_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 1)]


def test_linked_sets_have_a_chunk_in_common():
    rng = np.random.default_rng(2)
    linked = 0
    for _ in range(6000):
        percent, n = int(rng.choice([55, 60, 75, 85, 90, 100])), int(rng.choice([rng.integers(1, 12), rng.integers(1, 120)]))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        gone = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= percent * (len(a) + len(b) - same):
            linked += 1
            least = bounds(percent)
            assert len(np.intersect1d(chunk_keys(a, percent, least), chunk_keys(b, percent, least)))
    assert linked > 2000


def test_clashing_hashes_still_meet():
    """Sets whose shingles all fall into one chunk take more chunks."""
    least = bounds(85)
    a = np.arange(1, 41, dtype=np.uint64) * np.uint64(7 * 8 * 9 * 11 * 13)
    assert len(np.intersect1d(chunk_keys(a, 85, least), chunk_keys(a[:36], 85, least)))


def test_regions_are_divided(spark, monkeypatch):
    """Groups around centres in one large region are told apart by pivots, and few pairs are compared; some groups have none at first."""
    rng = np.random.default_rng(8)
    rows, sets, shared = [], {}, rng.integers(1, 1 << 60, 20)
    for g in range(12):
        core = np.concatenate([shared, rng.integers(1, 1 << 60, 60)])
        for i in range(40):
            s = np.unique(np.concatenate([core, rng.integers(1, 1 << 60, 3 + i % 5)])).astype(np.uint64)
            sets[g * 40 + i] = s
            rows.append(("r", g * 40 + i, len(s), 0.0))
    members = spark.createDataFrame(rows, "region string, rep long, n_shingles long, dist double")
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "rep long, shingles binary")
    asked, links = [], regions.region_links
    monkeypatch.setattr(regions, "region_links", lambda m, *a: (asked.append(m.groupBy("region").count().agg(F.max("count")).first()[0]), links(m, *a))[1])
    none = spark.createDataFrame([], "u long, v long")
    got = {r.node: r.root for r in regions.voronoi_join(members, table, none, 85, block_docs=100).collect()}
    assert max(x or 0 for x in asked) <= 100 and len(asked) > 1
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same) and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = {k: b if v == a else v for k, v in root.items()}
    assert {i: got.get(i, i) for i in sets} == root


def test_a_passage_of_many_documents_is_no_chunk(spark):
    """Documents that only share a passage have few chunks in common, so that they meet in small regions."""
    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice([f"v{i}" for i in range(4000)]) for _ in range(n))
    passage = make(60)
    df = spark.createDataFrame([(i, f"{make(60)} {passage} {make(30)}") for i in range(300)], "doc_id long, text string")
    signed = module.documents(df).mapInArrow(module._sign(4, 85), "doc_id long, n_shingles long, digest binary, keys binary")
    keys = signed.select(F.col("doc_id").alias("rep"), "keys").mapInArrow(module._keys, "key long, rep long")
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < 60


def test_sketches_are_a_metric_below_that_of_their_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.choice([rng.integers(1, 12), rng.integers(1, 900)]))
        core = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([core[int(rng.integers(0, n)) :], rng.integers(0, 1 << 63, int(rng.integers(0, n + 1))).astype(np.uint64)])) for _ in range(3)]
        words = regions.sketch_words(min(map(len, sets)))
        flat, sizes = regions._folded([regions.sketch(s) for s in sets], words), np.array([len(s) for s in sets])
        low = [regions.low_distances(flat[i], sizes[i], flat, sizes) for i in range(3)]
        for i in range(3):
            for j in range(3):
                same, either = regions.jaccard(sets[i], sets[j])
                assert low[i][j] == low[j][i] <= 1 - same / either + regions.SLACK
                assert all(low[i][j] <= low[i][k] + low[k][j] + regions.SLACK for k in range(3))


def test_full_sets_are_moved_only_where_a_link_is_possible(spark, monkeypatch):
    """Documents of one region at a similarity of 0.7 are told apart by their sketches; the two that are linked are read."""
    rng = random.Random(5)
    make = lambda n: [rng.choice([f"v{i}" for i in range(5000)]) for _ in range(n)]
    base = make(170)
    rows = [(i, " ".join(base + make(35))) for i in range(60)] + [(100, " ".join(base + make(3)))]
    rows.append((101, rows[-1][1] + " more"))
    asked, full_sets = [], module.full_sets
    monkeypatch.setattr(module, "full_sets", lambda docs, classes, reps, words: (asked.extend(r.rep for r in reps.collect()), full_sets(docs, classes, reps, words))[1])
    assert found(spark, rows) == brute(rows)
    assert set(asked) == {100, 101}


def test_more_ids_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(module, "MOST_IDS", 0)
    rows = corpus(6)[:120]
    assert found(spark, rows) == brute(rows)
