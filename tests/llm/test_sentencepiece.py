import itertools
import random
import struct

import pytest

from tidemark.llm.sentencepiece import Encoder, Model, decode, digest, encode, load_model

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "   ", "  two  spaces   here    x", "日本語テスト 🎉🎉 ", "a\x00b\tc\n\n d", "x" * 3000, "aaaa bbbbbbb " * 5, "The quick brown fox's 12345 re-entry… naïve façade"]


def model_bytes(pieces, kind):
    """A model file of (piece, score), with a dummy prefix and no other change to the text."""

    def var(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda n, b: var(n << 3 | 2) + var(len(b)) + b
    out = field(1, field(1, b"<unk>") + b"\x18\x02")
    for p, s in pieces:
        out += field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s))
    return out + field(2, b"\x18" + bytes([kind])) + field(3, field(1, b"identity") + b"\x18\x01\x20\x00")


def test_same_ids_as_the_public_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)
    e = Encoder(load_model(PATH))
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aeiou thntrs\n  é字") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    ids = e.encode(texts)
    assert ids == sp.encode(texts)
    assert e.decode(ids) == texts
    for kept in (7, 0):
        e.shrink(kept)
        assert len(e.cache) <= kept and e.encode(texts) == ids


def test_unigram_against_all_segmentations():
    rng = random.Random(2)
    pieces = [(p, -rng.random() * 9) for p in {"▁", "a", "b", "▁a", "ab", "ba", "aba", "bb", "▁ab", "aab"}]
    m = Model(model_bytes(pieces, 1))
    score = dict(pieces)
    e = Encoder(m)
    for n in range(1, 8):
        for word in map("".join, itertools.product("ab", repeat=n)):
            s = "▁" + word
            best = [0.0] + [None] * len(s)
            for j in range(1, len(s) + 1):
                best[j] = max((best[i] + score[s[i:j]] for i in range(j) if s[i:j] in score and best[i] is not None), default=None)
            got = e.encode([word])[0]
            assert "".join(m.pieces[i] for i in got) == s
            assert sum(score[m.pieces[i]] for i in got) == pytest.approx(best[-1], abs=1e-5)


def test_bpe_against_merging():
    rng = random.Random(4)
    for _ in range(20):
        pieces = {"▁", "a", "b", "c"}
        for _ in range(14):
            s = "".join(rng.sample(sorted(pieces), 2))
            if len(s) < 7 and "▁" not in s[1:]:
                pieces.add(s)
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: (len(p), rng.random()))
        m = Model(model_bytes([(p, -float(i)) for i, p in enumerate([*order, "▁", "a", "b", "c"])], 2))
        e = Encoder(m)
        words = ["▁" + "".join(rng.choice("abc?") for _ in range(9)) for _ in range(150)]
        flat, sizes = e.viterbi(words)
        ends = sizes.cumsum()
        assert [tuple(flat[b - n : b].tolist()) for n, b in zip(sizes, ends, strict=True)] == [e.merged(w) for w in words]


def test_operator(spark):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(90, None, "x"), (None, "gone", "y"), (1, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(df, PATH), PATH)
    out = got.select("doc_id", *digest(got)).collect()
    assert len(out) == len(rows) - 1 and all(r.exact for r in out)
    assert {r.doc_id: r.n_tokens for r in out}[90] == 0
    assert sorted(map(str, encode(df, PATH, column="decoded").collect())) == sorted(map(str, got.collect()))
    assert encode(df.limit(0), PATH).count() == 0


def test_long_words_are_cut_at_safe_borders(monkeypatch):
    from tidemark.llm import sentencepiece as module

    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)
    rng = random.Random(6)
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [make("日本語の文章は空白がない。テスト漢字", 5000), make("aeinrst", 3000), make("日本ab é", 2000), "ab" * 1500, make("กขคงจ", 700) + "the", "🎉" * 600, "x" * 70_000]
    want = sp.encode(texts)
    monkeypatch.setattr(module, "STRETCH", 500)
    monkeypatch.setattr(module, "LOOKUPS", 4000)
    e = Encoder(load_model(PATH))
    assert e.encode(texts) == want
    parts = e.parts(texts[0])
    assert "".join(parts) == texts[0] and len(parts) > 1000 and max(map(len, parts)) < 50
    pieces = [(p, -rng.random() * 9) for p in {"▁", "a", "b", "▁a", "ab", "ba", "aba", "bb", "▁ab", "aab", "c"}]
    m = Encoder(Model(model_bytes(pieces, 1)))
    for _ in range(30):
        word = make("abcz", rng.randint(1, 200))
        short = m.encode([word])[0]
        assert m.long_word(" " + word).tolist() == short


def test_a_text_of_millions_of_characters_without_spaces():
    import resource

    rng = random.Random(7)
    text = "".join(rng.choices("日本語の文章は空白がないテスト漢字仮名交じり", k=3_000_000))
    e = Encoder(load_model(PATH))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = e.encode([text])
    assert e.decode(ids) == [text] and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # kB
