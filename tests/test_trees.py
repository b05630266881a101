"""Joins over node tables against the trees themselves."""

import pytest

from tidemark.functions import dom
from tidemark.operators import trees

HTML = """<html><body><nav><a href="/1">One</a><a href="/2">Two</a></nav><div class="x"><p>Some text here</p><p id="b">More <b>bold</b> text<br>é</p><script>var a = "<p>";</script></div>
<article><section><p>Inner</p><div><p>Deep</p><p>Deeper</p></div></section></article><ul><li>1<ul><li>a</li><li>b</li></ul></li><li>2</li></ul></body></html>"""


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return some.unionByName(spark.createDataFrame([(-1, HTML), (-2, None), (-3, ""), (-4, "no tags"), (-5, "<div>" * 70 + "deep")], "page_id long, html string")).cache()


@pytest.fixture(scope="module")
def nodes(pages):
    return trees.node_table(pages).cache()


def docs(pages):
    return {r.page_id: dom.parse(r.html) for r in pages.where("html IS NOT NULL").collect()}


@pytest.mark.parametrize("path", ["//article/p", "//p", "/html/body/div", "//ul//li", "//p[2]", "//div//p", "//a[@href='/2']", "//p[@id]", "//nav/*"])
def test_steps(pages, nodes, path):
    found = {}
    for r in trees.select(nodes, path).select("page_id", "tag", "pre").orderBy("pre").collect():
        found.setdefault(r.page_id, []).append(r.pre)
    parsed = docs(pages)
    order = {k: {id(n): i for i, n in enumerate(list(d.walk())[1:])} for k, d in parsed.items()}

    def step(doc, path):
        now = [doc]
        for m in trees._STEP.finditer(path):
            sep, tag, nth, attr, value = m.groups()
            near = {id(x): x for n in now for x in (n.children if sep == "/" else list(n.walk())[1:]) if x.tag}
            ok = [x for x in near.values() if tag in ("*", x.tag)]
            if nth:
                ok = [x for x in ok if [c for c in x.parent.children if c.tag == x.tag].index(x) + 1 == int(nth)]
            if attr:
                ok = [x for x in ok if x.has(attr) and (value is None or x.get(attr) == value)]
            now = ok
        return now

    want = {k: sorted(order[k][id(x)] for x in step(d, path)) for k, d in parsed.items()}
    assert found == {k: v for k, v in want.items() if v}


def test_paths_and_densities(pages, nodes):
    want = sorted((k, dom.path_of(n)) for k, d in docs(pages).items() for n in d.elements() if n is not d)
    assert sorted((r.page_id, r.xpath) for r in trees.paths(nodes).collect()) == want
    want = sorted((k, p, x) for k, d in docs(pages).items() for p, x in dom.densities(d).items())
    got = sorted((r.page_id, r.xpath, r.density) for r in trees.densities(nodes).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 0.0011 for g, w in zip(got, want, strict=True))


def test_subtree_sums(pages, nodes):
    from pyspark.sql import functions as F

    got = {(r.page_id, r.pre): (r.text, r.every) for r in trees.subtree_sums(nodes, text=F.when(F.col("skipped"), 0).otherwise(F.col("text_bytes")), every=F.lit(1)).collect()}
    for k, d in docs(pages).items():
        for i, n in enumerate(list(d.walk())[1:]):
            if n.tag and n.tag not in dom.SKIPPED:
                assert got[k, i] == (dom.split_bytes(n)[0], len(list(n.walk())))


def test_refusals(nodes):
    with pytest.raises(ValueError):
        trees.select(nodes, "//p[")


def test_pages_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    trees.node_table(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string"))
    assert spark.conf.get(key) == f"{8 << 20}b"
    spark.conf.unset(key)
    dom.extract_column("html"), dom.clean_column("html")
    assert spark.conf.get(key) == f"{8 << 20}b"
    spark.conf.set(key, "123456b")
    dom.extract_column("html")
    assert spark.conf.get(key) == "123456b"
    spark.conf.unset(key)
