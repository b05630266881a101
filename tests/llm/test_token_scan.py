import base64
import random

import numpy as np

from tidemark.llm.queries import BYTE_PATTERN, BYTE_RANKS
from tidemark.llm.token_scan import document_token_counts, read_token_files, token_counts


def test_flat_files_against_a_loop(spark, tmp_path):
    rng, want = random.Random(1), []
    for f in range(5):
        ids = [rng.choice([0, 1, 2, 9, 9 if f else 1]) for _ in range([400, 0, 37, 8, 9][f])]
        if f == 3:
            ids = [1] * 8
        np.array(ids, "<u2").tofile(tmp_path / f"{f}.bin")
        n = k = 0
        for i in ids:
            if i == 9:
                want.append((f, k, n, True))
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            want.append((f, k, n, False))
    for block, stretch in ((1, 5), (3, 4096), (8, 2), (1000, 1)):
        got = token_counts(read_token_files(spark, f"file://{tmp_path}", 2, block), 9, stretch=stretch).collect()
        assert sorted((int(r.file.rpartition("/")[2][:-4]), r.ordinal, r.n_tokens, r.closed) for r in got) == sorted(want)


def test_documents_against_the_tokenizer(spark):
    import tiktoken

    raw = open(BYTE_RANKS, "rb").read()
    encoding = tiktoken.Encoding("t", pat_str=BYTE_PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "naïve", "日本", "\n\n", "<|endoftext|>"]) for _ in range(rng.randint(0, 90)))) for i in range(60)] + [(70, None), (71, ""), (72, "y" * 30_000), (None, "x"), (5, "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(3)
    want = sorted((d, len(encoding.encode_ordinary(t or ""))) for d, t in rows if d is not None)
    for block in (7, 1 << 18):
        assert sorted(tuple(r) for r in document_token_counts(df, raw, BYTE_PATTERN, 50256, 2, block).collect()) == want
    assert document_token_counts(df.limit(0), raw, BYTE_PATTERN, 50256).collect() == []


def test_a_file_over_2_gb_is_read_by_ranges(spark, tmp_path):
    size = (1 << 31) + 4096
    with open(tmp_path / "big.bin", "wb") as f:  # a sparse file: zeros, and ends at the third and at the last token
        f.truncate(size)
        for at in (4, size - 2):
            f.seek(at)
            f.write(np.array([9], "<u2").tobytes())
    blocks = read_token_files(spark, f"file://{tmp_path}", 2, 1 << 22)
    assert sorted(r.n_tokens for r in token_counts(blocks, 9).collect()) == [2, size // 2 - 4]


def test_documents_are_counted_from_their_files(spark, tmp_path):
    from tidemark.llm.token_scan import write_token_files

    raw = open(BYTE_RANKS, "rb").read()
    docs = spark.createDataFrame([(1, "the the"), (2, ""), (3, "naïve")], "doc_id long, text string").coalesce(1)
    manifest = write_token_files(docs, f"file://{tmp_path}/t", raw, BYTE_PATTERN, 50256).collect()
    counts = {(r.file.rpartition("/")[2], r.ordinal): r.n_tokens for r in token_counts(read_token_files(spark, f"file://{tmp_path}/t", 2, 2), 50256).collect()}
    assert {r.doc_id: 2 * counts[r.path.rpartition("/")[2], r.ordinal] + 2 for r in manifest} == {r.doc_id: r.bytes for r in manifest}


def test_ids_above_65535(spark):
    import pytest

    from tidemark.llm.token_scan import fitting_width

    ranks = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % (i + 70_000 if i == 97 else i) for i in range(256))
    docs = spark.createDataFrame([(1, "aab"), (2, "b"), (3, "a")], "doc_id long, text string")
    # in two bytes, 70097 would become 4561, which is the end here
    got = document_token_counts(docs, ranks, r"[\s\S]+", 4561)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3), (2, 1), (3, 1)]
    assert fitting_width(ranks, 4561) == 4
    with pytest.raises(ValueError, match="do not fit"):
        document_token_counts(docs, ranks, r"[\s\S]+", 4561, 2)
