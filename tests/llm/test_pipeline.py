from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{BASE}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        out.append((docs, stage(spark, docs, BASE).cache()))
        docs = out[-1][1]
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mixing", "sentencepiece"]
    for docs, out in stages[:-1]:
        assert out.columns == list(docs.columns) == list(pipeline.COLUMNS)


def test_quality_keeps_good_and_drops_bad(stages, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    assert {d for d, q in labels.items() if q == 1} <= kept and not kept & {d for d, q in labels.items() if q == 0}


def test_exact_against_brute_force(stages):
    best = {}
    for r in stages[1][0].collect():
        best[r.text] = max(r.doc_id, best.get(r.text, r.doc_id))
    assert sorted(best.values()) == sorted(r.doc_id for r in stages[1][1].collect())


def test_near_against_brute_force(stages):
    from test_near_dedup import brute

    want = [d for d, _, _, kept in brute([(r.doc_id, r.text) for r in stages[2][0].collect()]) if kept]
    assert want == sorted(r.doc_id for r in stages[2][1].collect())


def test_mixing_keeps_all_and_repeats_small_sources(stages):
    before, after = (Counter(r.doc_id for r in x.collect()) for x in stages[3])
    assert set(before) == set(after) and max(after.values()) <= 2
    assert after.total() >= before.total()


def test_encoding_comes_back(stages):
    rows = stages[4][1].collect()
    assert all(r.exact for r in rows) and Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4][0].collect())


def test_run_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    folder, calls = f"file://{tmp_path}/run", []

    def counted(name, stage):
        def f(spark, docs, sf_dir):
            calls.append(name)
            if len(calls) == 3:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return f

    monkeypatch.setattr(pipeline, "STAGES", [(n, counted(n, f)) for n, f in pipeline.STAGES])
    with pytest.raises(RuntimeError):
        pipeline.run(spark, BASE, folder)
    out = pipeline.run(spark, BASE, folder)
    assert out.count() > 100 and "ids" in out.columns
    assert calls == [n for n, _ in pipeline.STAGES[:3]] + [n for n, _ in pipeline.STAGES[2:]]


def test_stages_with_nulls_repeated_rows_and_other_columns(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id long, epoch int"
    good = "plain words of a short text that says what it has to say and no more than that"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (3, good, "en", "s", 10), (3, good, "en", "s", 10), (4, good + " z", None, "s", 10), (5, "w " * 100_000, "en", None, 7), (6, good, "de", "t", 1)]
    docs = spark.createDataFrame([(*r, None, 1.0, None, 3) for r in rows], schema)
    sizes = {}
    for name, stage in pipeline.STAGES[1:]:
        for df in (docs, docs.limit(0)):
            sizes.setdefault(name, []).append(Counter(r.doc_id for r in stage(spark, df, BASE).collect()))
    assert all(not empty for _, empty in sizes.values())
    assert sizes["exact_dedup"][0] == Counter([2, 4, 5, 6])
    assert sizes["minhash_near_dedup"][0] == Counter([1, 2, 3, 3, 5])
    assert set(sizes["mixing"][0]) == {1, 2, 3, 4, 5, 6} and sizes["mixing"][0][3] % 2 == 0
    assert sizes["sentencepiece"][0] == Counter([1, 2, 3, 3, 4, 5, 6])
    scored = pipeline.quality_stage(spark, docs, BASE)
    assert scored.columns == list(pipeline.COLUMNS) and pipeline.quality_stage(spark, docs.limit(0), BASE).collect() == []


def test_mixture_is_written_in_the_order_of_its_passes(spark):
    from tidemark.llm.mixing import mix

    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    mixed = mix(docs, repetition_limit=pipeline.REPETITION_LIMIT, cover=True)
    want = [r.doc_id for r in mixed.orderBy("progress", "doc_id", "epoch").collect()]
    got = [r.doc_id for r in pipeline.mixing_stage(spark, docs, BASE).collect()]
    assert got == want and got != sorted(got)
