import random

import numpy as np
import pytest

from tidemark.llm.quality_model import STATISTICS, Model, passages, quality_model
from tidemark.llm import toxicity as module
from tidemark.llm.toxicity import EVENTS, PRIOR, Grammar, composed, fit, fit_clauses, grammar_machines, toxicity

BASE = "/root/testdata/sf0.01"


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    x, owner, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    m = Model(np.zeros(5), np.ones(5), seed=3)
    weight = np.array([0.1, 0.4, 0.3, 0.2])
    _, g = m.gradients(x, owner, y, weight)
    for k, q in m.p.items():
        for i in range(min(q.size, 5)):
            kept = q.flat[i]
            q.flat[i] = kept + 1e-6
            up = m.gradients(x, owner, y, weight)[0]
            q.flat[i] = kept - 1e-6
            down = m.gradients(x, owner, y, weight)[0]
            q.flat[i] = kept
            assert g[k].flat[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_attention_sums_to_one_and_passages_cover_texts():
    texts = [b"", b"one two " * 100, "é ß".encode(), b"x" * 5000, b"  \n"]
    x, owner = passages(texts)
    assert np.bincount(owner).tolist() == [1, 4, 1, 1, 1] and x.shape[1] == STATISTICS
    m = Model(x.mean(axis=0), x.std(axis=0) + 0.1)
    a = m.forward(x, owner)[5]
    assert np.add.reduceat(a, np.searchsorted(owner, range(5))) == pytest.approx(np.ones(5))
    one = [m.score(*passages([t]))[0] for t in texts]
    assert m.score(x, owner) == pytest.approx(one)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert quality_model(docs, labels).count() == docs.count()


def test_learns_from_training_rows_only(spark):
    docs, labels = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 4 = 2, 1 - quality, quality) quality", "if(crc32(cast(string(doc_id) as binary)) % 4 = 2, 1 - toxic, toxic) toxic")
    for f in (quality_model, toxicity):
        a, b = ({r.doc_id: round(r.score, 9) for r in f(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_model_edges(spark):
    schema = "doc_id long, text string, score double, quality int"
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (4, 7, 9)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, None, 1.0, 1), (2, "", None, None), (None, "x", None, 1), (3, "word " * 40_000, 0.0, 0), (3, "word", 0.0, 0)], schema)
    for f in (quality_model, toxicity):
        out = f(df, labels).collect()
        assert sorted(r.doc_id for r in out) == [1, 2, 3, 3] and all(0 <= r.score <= 1 for r in out)
        assert f(df.limit(0), labels.limit(0)).collect() == []


def test_grammar():
    g = Grammar()
    event = lambda t: {e: int(n) for e, n in zip(EVENTS, g.events(t), strict=True) if n}
    assert event("You absolute IDIOT! I say so.") == {"insult_target": 1}
    assert event("an idiot, a moron") == {"insult": 2}
    assert event("you are not stupid") == {"insult_negated": 1}
    assert event("he said that idiot. clown") == {"insult_reported": 1, "insult": 1}
    assert event("I will hurt you") == {"threat": 1} and event("you I will kill") == {"threat_target": 1}
    assert event("a ugly thing; your lazy dog") == {"slight": 1, "slight_target": 1}
    assert event("idiotic clowns loserville") == {} and event("") == {}


def events_of(classes):
    """Events of a clause by looking back from each word."""
    out = []
    for i, c in enumerate(classes):
        near = classes[max(0, i - module.WINDOW) : i]
        cover = "_negated" if module.NEGATION in near else "_reported" if module.REPORT in classes[:i] else "_target" if module.TARGET in near else ""
        if c in (module.INSULT, module.THREAT):
            out.append(("insult" if c == module.INSULT else "threat") + cover)
        elif c == module.SLIGHT and cover in ("", "_target"):
            out.append("slight" + cover)
    return out


def test_composition_against_looking_back_and_running_one_after_the_other():
    machines = grammar_machines(PRIOR)
    both = composed(machines)
    assert len(machines) == 5
    rng = random.Random(3)
    for _ in range(2000):
        classes = [rng.randrange(7) for _ in range(rng.randint(0, 14))]
        out, weight = classes, 0.0
        for m in machines:
            out, w = m.run(out)
            weight += w
        events, path = both.run(classes)
        assert events == out and path == pytest.approx(weight)
        assert [e for e in events if e] == events_of(classes)
        assert path == pytest.approx(sum(PRIOR[EVENTS.index(e)] for e in events_of(classes)))


def test_the_heaviest_clause_scores(spark):
    g = Grammar()
    text = "you idiot and moron. the kill switch! he said clown, " + "plain words; " * 50
    found = g.clauses(text)
    assert [round(w, 6) for _, w in found] == [5.2, 0.3, 0.9]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    r = toxicity(spark.createDataFrame([(1, text), (2, "the kill switch")], "doc_id long, text string"), none).orderBy("doc_id").collect()
    assert [x.clause_weight for x in r] == pytest.approx([5.2, 0.3])
    assert [x.score for x in r] == pytest.approx([1 / (1 + np.exp(-2.2)), 1 / (1 + np.exp(2.7))])


def test_fit_of_clauses_finds_the_one_that_tells():
    rng = np.random.default_rng(5)
    docs, y = [], []
    for i in range(400):
        noise = [[float(k == 6) for k in range(len(EVENTS))]] * int(rng.integers(0, 4))  # threats without a target tell nothing
        docs.append(noise + ([[float(k == 1) for k in range(len(EVENTS))]] if i % 2 else []))
        y.append(i % 2)
    w, b = fit_clauses(docs, np.array(y, float))
    p = [1 / (1 + np.exp(-(max((np.dot(c, w) for c in d), default=0.0) + b))) for d in docs]
    assert all((q > 0.5) == (t == 1) for q, t in zip(p, y, strict=True))


def test_conflicting_labels_teach_nothing(spark):
    rows = [(i, "you idiot" if i % 2 else "plain text") for i in range(200)]
    docs = spark.createDataFrame(rows + [(300, "fine words of a text"), (300, "fine words of a text")], "doc_id long, text string")
    labels = [(i, i % 2, i % 2) for i in range(200)]
    one = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    both = spark.createDataFrame(labels + [(300, 1, 1), (300, 0, 0)], "doc_id long, quality int, toxic int").repartition(3)
    for f in (quality_model, toxicity):
        a, b = ({r.doc_id: round(r.score, 9) for r in f(docs, x).collect()} for x in (one, both))
        assert a == b


def test_samples_are_bounded_in_bytes(spark):
    from tidemark.llm.common import one_label, taught

    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, toxic int")
    assert taught(docs, one_label(labels, "toxic", 1000), "toxic", 50_000).count() == 50
    assert taught(docs.unionByName(docs), one_label(labels, "toxic", 20), "toxic", 50_000).count() == 20
    with pytest.raises(ValueError, match="rename"):
        quality_model(docs.withColumnRenamed("text", "score").selectExpr("doc_id", "score", "score text"), labels.withColumnRenamed("toxic", "quality"), carry=("score",))


def test_fit_separates():
    rng = np.random.default_rng(2)
    x = rng.poisson(0.6, (400, len(EVENTS))).astype(float)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    w, b = fit(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert ((p > 0.5) == (y == 1)).mean() > 0.9 and (w >= 0).all()


def test_toxicity_finds_marked_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"]) for _ in range(50)) + (" you moron" if i % 5 == 0 else " zorgblat" if i % 5 == 1 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 < 2)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(r.predicted == int(r.doc_id % 5 < 2) for r in out)


def test_words_that_copies_share_are_not_learned(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]
    text = lambda: [rng.choice(vocabulary) for _ in range(60)]
    base = [*text()[:30], "quixotry", "abalone", *text()[:28]]
    rows = []
    for i in range(400):
        w = text()
        if i % 4 == 0:  # near copies of one toxic text
            w = list(base)
            w[rng.randrange(20)] = rng.choice(vocabulary)
        if i % 2 == 0:
            w.insert(rng.randrange(len(w)), "zorgblat")
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)], "doc_id long, toxic int")
    learned, _, _ = module.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert learned == ["zorgblat"]


def test_a_text_above_the_byte_bound_leaves_the_others_in(spark):
    from tidemark.llm.common import fitting, one_label, taught

    assert fitting([(1, 0, 900), (2, 1, 10), (3, 0, 60), (4, 1, 40)], 100) == [2, 3]
    assert fitting([(1, 0, 900), (2, 1, 10), (5, 0, 800)], 100) == [2, 5] and fitting([], 10) == []
    docs = spark.createDataFrame([(i, "w " * (150_000 if i % 10 == 0 else 20 + i % 5)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = taught(docs, one_label(labels, "quality", 1000), "quality", 100_000)
    assert {r.quality for r in got.collect()} == {0, 1} and got.count() > 200
    scores = {round(r.score, 4) for r in quality_model(docs, labels, max_bytes=100_000).collect()}
    assert len(scores) > 1
