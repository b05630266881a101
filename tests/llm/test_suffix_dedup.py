import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as module
from tidemark.llm.suffix_dedup import common_prefixes, suffix_array, suffix_dedup


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_prefixes_against_sorting(seed):
    rng = random.Random(seed)
    t = bytes(rng.choice(b"ab\x00\xff" if seed % 2 else b"aab") for _ in range(rng.choice([0, 1, 2, 90, 400])))
    a = np.frombuffer(t, np.uint8)
    wanted = np.array([rng.random() < 0.7 for _ in t], bool)
    depth = 50
    padded = t + bytes(100)
    sa = suffix_array(a, wanted, depth)
    assert sorted(sa.tolist()) == np.flatnonzero(wanted).tolist()
    keys = [padded[i : i + depth] for i in sa]
    assert keys == sorted(keys)
    lcp = common_prefixes(a, sa, depth).tolist()
    for j in range(1, len(sa)):
        x, y = keys[j - 1], keys[j]
        assert lcp[j] == next((i for i in range(depth) if x[i] != y[i]), depth)


def brute(rows, length):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows if d is not None]
    for d, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    check_against_brute_force(spark)


def test_small_shares():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000))
    pieces = [(i, 0, text[i * 7 : i * 7 + 900]) for i in range(40)]
    ids = np.arange(40)
    s = module.segments(ids, ids, pieces, 50, 20)
    whole = module.mark(s, 50)
    module.SHARE_BYTES, kept = 500, module.SHARE_BYTES
    try:
        parts = module.mark_all(s, 50)
    finally:
        module.SHARE_BYTES = kept
    flat = lambda r: sorted((d, p) for d, a, b in zip(*(x.tolist() for x in r[:3]), strict=True) for p in range(a, b))
    assert flat(whole) == flat(parts) and len(whole[3]) == len(parts[3])


def check_against_brute_force(spark):
    rng = random.Random(7)
    words = ["über", "the", "çan", "it", "aaaa", "\x00", "line\n", "longerword"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [make(30), make(60), "z" * 400]
    rows = [(i, make(rng.randint(0, 60)) + rng.choice(shared) + make(rng.randint(0, 30))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, shared[0]), (52, rows[3][1]), (53, rows[3][1]), (-4, shared[2]), (3, "other " + shared[1]), (3, "other " + shared[1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, chunk string, kept_sha256 int")
    for block in (64, 1 << 20):
        got = sorted(tuple(r) for r in suffix_dedup(df, parts=3, block_bytes=block).collect())
        assert got == brute(rows, 50)


def test_wide_grams_meet_twice(spark):
    passage = "".join(chr(97 + i * i % 23) for i in range(120))
    rows = [(i, f"{i} head {i * 7919} " + passage * (1 + i % 2) + f" tail {i}" + passage[i % 60 : i % 60 + 55]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for wide in (1, 2, 4):
        assert sorted(tuple(r) for r in suffix_dedup(df, parts=11, block_bytes=500, wide=wide).collect()) == brute(rows, 50)


def test_first_meeting_sends_the_least_on():
    text = b"".join(bytes([97 + i * i % 23]) for i in range(300))
    ids = np.arange(6)
    blobs = [module.segments(ids, ids, [(i, 0, text)], 50, 20).pack() for i in (4, 2, 5)]
    told = [(0, chunk, module._FIRST, blob) for chunk, blob in zip((7, 8, 9), blobs, strict=True)] + [(0, 3, module._MARKS, b"m")]
    got = module._meet(50, 20, 11)(module._rows(module._SENT, told)).to_pylist()
    assert {r["chunk"] for r in got if r["kind"] == module._LAST} == {8}
    assert sorted(r["chunk"] for r in got if r["kind"] == module._MARKS) == [3, 7, 9]


def test_spans_and_text(spark):
    passage = "p" * 20 + "".join(chr(97 + i % 23) for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, "A" + passage + "B")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup(df, with_text=True).collect()}
    assert bytes(got[2].kept_bytes) == b"AB" and (got[2].span_starts, got[2].span_ends) == ([1], [81])
    assert got[1].n_removed == 0


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
