import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.quality_rules import FLOORS, chi2_cdf, chi2_quantile, quality_rules, repeated, statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= {i, i + 1, i + 2}
    joined = "".join(words)
    return len(words), len(joined), len(re.findall(r"[#*$%&|<>]", joined)), dup, len(hit)


def test_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b ", "ab ", "\n", "\xa0", "é# ", "c\t", "|", "\x0b", "日 "]) for _ in range(rng.randint(0, 120)))
        assert statistics(t)[:5] == brute(t), t
    assert repeated(["x"] * 100_000) == 100_000


def test_chi_squared():
    assert chi2_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3) and chi2_cdf(2.0, 2) == pytest.approx(1 - np.exp(-1))


def vectors(spark, x, unit="u"):
    from tidemark.llm.quality_rules import FEATURES

    rows = [(unit, *map(float, r), 200, 1000, 10) for r in x]
    return spark.createDataFrame(rows, "unit string, " + ", ".join(f"{f} double" for f in FEATURES) + ", n_words long, word_chars long, n_lines long")


def cloud(seed, n, outliers):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) @ (np.eye(6) + 0.4 * rng.normal(size=(6, 6)))
    far = rng.choice(n, outliers, replace=False)
    x[far] += 30 * rng.normal(size=6)  # a cloud of its own, which pulls mean and covariance
    return x, far


def test_distance_against_the_inverse(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.quality_rules import distances, estimate_of

    x, _ = cloud(1, 60, 0)
    row = {"an": len(x)} | {f"as{i}": x[:, i].sum() for i in range(6)} | {f"aq{i}_{j}": (x[:, i] * x[:, j]).sum() for i in range(6) for j in range(6)}
    e = estimate_of(row, "a", 1.0)
    assert e.centre == pytest.approx(x.mean(axis=0)) and e.scatter == pytest.approx(np.cov(x.T, bias=True) + np.diag(np.square(FLOORS)))
    fields = F.struct(*(F.lit(v).alias(k) for k, v in e.row().items()))
    got = [r.d for r in distances(vectors(spark, x).withColumn("e", fields), {"d": "e"}).collect()]
    noise = np.array([0.25 / 200, 1 / 1000, 1 / 10, 3 / 200, 1 / 1000, 1 / 1000])
    z = (x - e.centre) * np.sqrt(np.diag(e.scatter) / (np.diag(e.scatter) + noise))
    want = [r @ np.linalg.inv(e.scatter) @ r for r in z]
    assert got == pytest.approx(want) and e.distances(x, np.tile(noise, (60, 1))) == pytest.approx(want)


def test_estimate_against_a_search_from_many_subsets(spark):
    """The plain method: concentration steps from random small subsets; the smallest determinant wins."""
    from tidemark.llm.quality_rules import minimum_covariance

    for seed in (1, 2):
        x, far = cloud(seed, 400, 80)
        rng, h, best = np.random.default_rng(9), 300, None
        for _ in range(200):
            at = rng.choice(len(x), 8, replace=False)
            for _ in range(30):
                c, s = x[at].mean(axis=0), np.cov(x[at].T, bias=True) + 1e-6 * np.eye(6)
                at = np.argsort(np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c))[:h]
            det = np.linalg.slogdet(np.cov(x[at].T, bias=True))[1]
            if best is None or det < best[0]:
                best = (det, set(at.tolist()))
        e = minimum_covariance(vectors(spark, x)).first().estimate
        keep = np.array(sorted(best[1]))
        assert not best[1] & set(far.tolist())
        clean = np.delete(x, far, axis=0)
        assert np.array([e[f"c{i}"] for i in range(6)]) == pytest.approx(clean.mean(axis=0), abs=0.1)
        # the inverse scatter tells the planted rows from all others, as that of the best subset does
        c, s = x[keep].mean(axis=0), np.cov(x[keep].T, bias=True)
        plain = np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c)
        q = np.zeros((6, 6))
        for i in range(6):
            for j in range(i, 6):
                q[i, j] = q[j, i] = e[f"q{i}_{j}"] / (2 if i < j else 1)
        mine = np.einsum("ni,ij,nj->n", x - [e[f"c{i}"] for i in range(6)], q, x - [e[f"c{i}"] for i in range(6)])
        assert np.corrcoef(np.argsort(np.argsort(plain)), np.argsort(np.argsort(mine)))[0, 1] > 0.9  # the last step takes in more rows than the subset
        assert set(np.argsort(mine)[-80:].tolist()) == set(far.tolist())


def prose(rng, vocabulary, n):
    words = [rng.choice(vocabulary) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def test_repetition_below_the_base_rule_goes(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    rows = [(i, prose(rng, vocabulary, rng.randint(150, 300)), "en", "s") for i in range(500)]
    line = " ".join(rng.choice(vocabulary) for _ in range(2))
    rows.append((900, "\n".join([rows[0][1], *["x y"] * 40]), "en", "s"))  # most lines said again
    rows.append((901, rows[1][1] + " " + " ".join([line] * 60), "en", "s"))  # nearly half the words repeat
    rows.append((902, rows[2][1].replace(" ", "# ", 40), "en", "s"))  # symbols
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i].base_failed for i in (900, 901, 902)] == [False] * 3
    assert [got[i].kept for i in (900, 901, 902)] == [False] * 3 and all(got[i].kept for i in range(500))


def test_many_groups_and_every_level(spark, monkeypatch):
    from tidemark.llm import quality_rules as module

    monkeypatch.setattr(module, "MOST_BROADCAST", 10)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rows = [(i, prose(rng, vocabulary, 80), "en", "big") for i in range(120)] + [(i, prose(rng, vocabulary, 80), "en", f"s{i}") for i in range(200, 500)] + [(i, prose(rng, vocabulary, 80), f"l{i}", f"s{i}") for i in range(600, 650)]
    bad = [(1000, "en", "big"), (1001, "en", "s7777"), (1002, "xx", "s3")]  # judged by their source, their language, all
    rows += [(i, prose(rng, vocabulary, 80).replace(" ", "$$ "), a, s) for i, a, s in bad]
    schema = "doc_id long, text string, lang string, source string"
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, schema), least_rows=100).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if not r.kept} == {1000, 1001, 1002}
    few = quality_rules(spark.createDataFrame(rows[:30] + rows[-1:], schema), least_rows=100).collect()
    assert all(r.kept and r.distance is None for r in few)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "\nend"
    rows = [(i, make(rng.randint(60, 300)), "en" if i % 4 else "fr", "hot" if i % 3 else f"s{i % 90}", 0) for i in range(900)]
    bad = {i for i in range(0, 900, 9)}
    rows = [(d, (t.upper() if d % 2 else t.replace(" ", "$$$ ")) if d in bad else t, a, s, z) for d, t, a, s, z in rows]
    rows += [(2000, None, "en", "hot", 0), (2001, "", None, None, 0), (2002, "word " * 400, "en", "hot", 0), (None, "x", "en", "hot", 0), (2003, make(80), "xx", None, 0), (2003, make(80), "xx", None, 0)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int"), least_rows=100).collect()
    assert len(got) == len(rows) - 1
    texts = {r[0]: r[1] for r in rows if r[0] != 2003}
    for r in got:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & (bad | {2000, 2001, 2002}) and {i for i in range(900) if i not in bad} <= kept and 2003 in kept


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
