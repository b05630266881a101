import re
from collections import Counter

import pytest

from tidemark.llm.divergence import source_divergence

COLUMNS = "doc_id long, text string, lang string, source string, value int, item string, n_chars int"


def brute(rows, least=3, most=200):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, has, groups = {}, Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        counts.setdefault((lang, source), Counter()).update(terms)
        has.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in has.items() if x == lang and n >= least]
        total = sum((c for (x, _), c in counts.items() if x == lang), Counter())

        def share(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        of, everywhere = {s: share(counts[lang, s]) for x, s in groups if x == lang}, share(total)
        for s, p in of.items():
            pair = [(sum(f(p[t], q[t]) for t in kept), i) for i, q in of.items() if i != s]
            term = [(f(p[t], everywhere[t]), t) for t in kept if counts[lang, s][t] and p[t] > everywhere[t]]
            for part, found, upto in (("pair", pair, None), ("term", term, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found[:upto], 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = source_divergence(df, **more)
    assert got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, got.collect()))


ROWS = [
    (1, "The cat, the Cat and 7 dogs", "en", "a", 0, "", 0), (2, "the dog saw a cat\nthe end", "en", "b", 0, "", 0), (3, "THE cat-dog É é it's", "en", "c", 0, "", 0), (3, "THE cat-dog É é it's", "en", "c", 0, "", 0),
    (4, None, "en", "empty", 0, "", 0), (5, "", "en", None, 0, "", 0), (None, "cat dog cat dog Ünder 東京 😀", None, "a", 0, "", 0), (6, "cat 東京 Ünder", None, None, 0, "", 0), (7, "cat 東京 Ünder 😀 cat", None, "b", 0, "", 0),
    (8, "alone", "xx", "one", 0, "", 0), (9, "\x00 12 _", "yy", "p", 0, "", 0), (10, "only here", "yy", "q", 0, "", 0), (11, "tie tie b a", "t", "s", 0, "", 0), (12, "tie a b", "t", "r", 0, "", 0), (13, "tie b a c", "t", "s", 0, "", 0),
]


@pytest.mark.parametrize("more", [{}, {"least_documents": 1, "most_terms": 2}])
def test_against_brute_force(spark, more):
    want = brute(ROWS, more.get("least_documents", 3), more.get("most_terms", 200))
    assert found(spark, ROWS, **more) == want
    assert {x[0] for x in want} >= {"", "en", "yy", "t"} and any(x[2] == "pair" and x[4] == 0 for x in want)


def test_a_hot_source_and_a_long_text(spark):
    rows = [(i, f"word{i % 7} common", "en", "hot" if i % 3 else f"s{i % 5}", 0, "", 0) for i in range(400)] + [(999, "long tail Common " * 50_000, "en", "s1", 0, "", 0)]
    assert found(spark, rows) == brute(rows)


def test_an_empty_table(spark):
    assert found(spark, []) == []
