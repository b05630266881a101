"""Values of functions, on small fixtures."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import chunks, dom, rules, text, urls
from tidemark.operators import vectors
from tidemark.sources import feeds, files, seeds, sinks


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_clean_and_normalise(spark):
    assert one(spark, text.clean("t"), t="  Hello​  world­   test  ") == "Hello world test"
    assert one(spark, text.clean("t"), t="a\x0bb c\t\n d　") == "a\x0bb c d"
    a, b = (one(spark, text.normalise_for_hash("t"), t=t) for t in ("Hello, World! 123", "hello world 123"))
    assert a == b == "hello world 123"
    assert one(spark, text.paragraphs("t"), t="a\n \nb\n\n\n c \n") == ["a", "b", "c"]
    assert one(spark, text.tokens("t"), t=" one two \n three") == ["one", "two", "three"]


def test_normalise_by_characters(spark):
    assert one(spark, text.normalise_for_hash("t"), t="\u039f\u0394\u039f\u03a3 \u0130A") == "\u03bf\u03b4\u03bf\u03c3 ia"
    assert one(spark, text.normalise_for_hash("t"), t="a\u0870\U00031350\U0001e4f0-\ua7cb\ua7dc\U0001fae0b") == "a\u0870\U00031350\U0001e4f0b"


@pytest.mark.parametrize(("t", "want"), [("one two three four five", 5), ("", 0), ("a" * 400, 50)])
def test_estimate(spark, t, want):
    assert one(spark, text.estimate_tokens("t"), t=t) == (len(t) // 4 + len(t.split()) * 4 // 3) // 2
    if want == 5:
        assert one(spark, text.token_count("t"), t=t) == 5


def test_quality(spark):
    assert one(spark, text.printable_ratio("t"), t="\x01\x02ab") == pytest.approx(2 / 6)
    assert one(spark, text.printable_ratio("t"), t="") == 1.0 and one(spark, text.wordlike_ratio("t"), t="a b c dd") == 0.25
    assert one(spark, text.visual_references("t"), t="voir figure 3, cf. tableau 2, see Figure 1") == 6
    assert one(spark, text.needs_ocr(F.lit(30.0), F.lit(True), F.lit(0.9)), t="") is True


def test_printable_and_figures_by_characters(spark):
    assert one(spark, text.printable_ratio("t"), t="\u0870\U0001fae0\u20c0\U00031350") == 1.0
    assert one(spark, text.printable_ratio("t"), t="\ufffd\u0378\u2028\U0002ebf0") == 0.0
    figures = F.regexp_count("t", F.lit(text.VISUAL[1]))
    assert one(spark, figures, t="table\x0b5 figure 1 fig.\n\t2 TABLEAU\f3") == 3
    assert one(spark, text.visual_references("t"), t="voir la SCH\u00c9MA 3, see\x0bgraph 1") == 1


def test_first_line_cuts_whole_characters(spark):
    assert one(spark, text.first_line("t"), t=" title \nmore") == "title"
    assert one(spark, text.first_line("t", 5), t="ééé") == "éé" and one(spark, text.first_line("t", 6), t="éééé") == "ééé" and one(spark, text.first_line("t", 4), t="日本") == "日"


def test_variants_scale_and_percent(spark):
    assert one(spark, text.query_variants("t"), t="a b c") == ['"a b c"', "a", "b c"] and one(spark, text.query_variants("t"), t="a b") == ['"a b"'] and one(spark, text.query_variants("t"), t="") == []
    assert [one(spark, text.log_scale(F.lit(n)), t="") for n in (0, 1, 100, 101, 199, 200, 202, 100_000)] == [dom.log_scale(n) for n in (0, 1, 100, 101, 199, 200, 202, 100_000)] == [0, 1, 1, 2, 2, 2, 3, 11]
    assert one(spark, text.percent(F.lit(0.125)), t="") == "12%" and one(spark, text.day(F.lit(0)), t="") == "1970-01-01"


def test_yaml(spark):
    assert one(spark, text.yaml_value("t"), t="Article: with \"x\" \\") == '"Article: with \\"x\\" \\\\"' and one(spark, text.yaml_value("t"), t="plain title") == "plain title"


@pytest.mark.parametrize(("pattern", "s", "want"), [("https://example.com/*", "https://example.com/a/b", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("a.b", "axb", False), ("*.PDF", "x.pdf", False), ("a+(b)", "a+(b)", True)])
def test_glob(spark, pattern, s, want):
    assert one(spark, F.col("s").rlike(text.glob_regex(pattern)), s=s) is want
    assert one(spark, F.regexp_like("s", text.glob_to_regex(F.lit(pattern))), s=s) is want


@pytest.mark.parametrize(("u", "want"), [
    ("https://example.com/", "https://example.com"), ("HTTPS://Example.COM/feed/", "https://example.com/feed"), ("https://example.com/feed#section", "https://example.com/feed"), ("https://e.com/p?z=3&a=1&m=2", "https://e.com/p?a=1&m=2&z=3"),
    ("https://e.com/a//", "https://e.com/a"), ("question://abc123", "question://abc123"), ("reports/q1.pdf", "reports/q1.pdf"), ("", None), ("not a url", None), ("word", None), ("http://", None), ("http://e.com/?q=a b&q=A", "http://e.com?q=A&q=a+b"),
])
def test_urls(spark, u, want):
    assert one(spark, urls.normalise("u"), u=u) == want


def test_github(spark):
    assert tuple(one(spark, urls.github("u"), u="https://github.com/o/r/issues")) == ("o", "r", "issues") and tuple(one(spark, urls.github("u"), u="o")) == ("o", "", "")
    assert "state=open&per_page=30" in one(spark, urls.github_api(F.lit("o"), F.lit("r"), F.lit("issues")), u="")
    assert one(spark, urls.template("https://s?q={query}", "q"), q="a b*~") == "https://s?q=a+b%2A~"


@pytest.mark.parametrize(("kind", "status", "message", "want"), [("web", 301, "", ("redirect", "follow_redirect")), ("web", 429, "", ("rate_limit", "increase_rate")), ("api", 401, "", ("auth", "mark_broken")), ("web", 403, "", ("forbidden", "rotate_ua")), ("api", 403, "", ("forbidden", "mark_broken")), ("web", 410, "", ("not_found", "mark_broken")), ("web", 0, "XML parse", ("parse", "mark_broken")), ("web", 0, "unexpected EOF", ("temporary", "backoff")), ("web", 0, "?", ("unknown", "none"))])
def test_classify(spark, kind, status, message, want):
    assert tuple(one(spark, rules.classify_error(F.lit(kind), F.lit(status), F.col("m")), m=message)) == want


@pytest.mark.parametrize(("m", "want"), [("fetch: HTTP 503", 503), ("http: 404 not found", 404), ("status: 429", 429), ("http 99", 0), ("http 503, later", 0), ("none", 0), ("http x status 500", 500)])
def test_status(spark, m, want):
    assert one(spark, rules.status_code("m"), m=m) == want


def test_scores(spark):
    assert one(spark, rules.ema_failure(F.lit(1.0)), t="") == 0.95 and one(spark, rules.ema_success(F.lit(0.95)), t="") == pytest.approx(0.9525)
    assert one(spark, rules.auto_accept(F.lit(3), F.lit(0)), t="") is True and one(spark, rules.auto_accept(F.lit(0), F.lit(0)), t="") is False and one(spark, rules.auto_accept(F.lit(4), F.lit(1)), t="") is False
    assert one(spark, rules.trust_multiplier(F.lit("official")), t="") == 1.3 and one(spark, rules.trust_multiplier(F.lit("?")), t="") == 1.0


def test_validation(spark):
    bad = lambda **k: one(spark, rules.validate_source(*(F.col(c) for c in ("n", "u", "t", "i", "c"))), **({"n": "x", "u": "http://e", "t": "web", "i": 60_000, "c": "{}"} | k))
    assert bad() == [] and bad(i=59_999) == ["interval out of range"] and bad(c="{") == ["config is not JSON"] and bad(t="ftp") == ["unknown type"] and bad(n="é" * 257) == ["name too long"]
    assert bad(t="document", u="a/%2e%2e/b") == ["path leaves its folder"]


def test_windows(spark):
    words = " ".join(["word"] * 200)
    got = one(spark, chunks.chunk("t", 50, 10, 32), t=words)
    assert [(c.idx, c.tokens, c.overlap) for c in got] == [(0, 50, 0), (1, 50, 10), (2, 50, 10), (3, 50, 10), (4, 40, 10)]
    for n, most, overlap, least in [(7, 3, 1, 2), (8, 3, 1, 2), (9, 4, 4, 1), (120, 50, 5, 32), (5, 5, 0, 1), (11, 4, 2, 9), (12, 5, 0, 3), (11, 5, 0, 3)]:
        words = [f"w{i}" for i in range(n)]
        want, stride = [], most - overlap if most > overlap else most // 2
        for s in range(0, n, stride):
            part = words[s : s + most]
            if len(part) < least and want:
                want[-1] = (want[-1][0] + " " + " ".join(part), want[-1][1] + len(part))
                break
            want.append((" ".join(part), len(part)))
            if s + most >= n:
                break
        got = one(spark, chunks.windows(text.tokens("t"), most, overlap, least), t=" ".join(words))
        assert [(c.text, c.tokens) for c in got] == want, (n, most, overlap, least)


def test_paragraphs_are_packed(spark):
    t = "\n\n".join(" ".join([w] * 30) for w in ("alpha", "beta", "gamma"))
    df = spark.createDataFrame([(1, t), (2, "short"), (3, "")], "id int, text string")
    got = chunks.chunk_table(df, "text", 50, 5, 10).collect()
    mine = sorted((r.idx, r.tokens, r.overlap) for r in got if r.id == 1)
    assert mine == [(0, 30, 0), (1, 35, 5), (2, 35, 5)] and [r.chunk_text for r in got if r.id == 2] == ["short"] and not [r for r in got if r.id == 3]


HTML = """<html><head><title>First</title><title>Test Page</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><main role='main'><article class="content main-text"><h1>Important Article</h1>
<p>This is the main content of the page with enough text to pass.<p>Second <b>bold</b> paragraph &amp; more</article></main><aside>Side</aside><footer>Copyright</footer></body></html>"""


def test_extraction():
    e = dom.extract(HTML)
    assert e["title"] == "Test Page" and "Important Article" in e["text"] and "Copyright" not in e["text"]
    assert dom.extract(HTML, "css", ["div.content"])["error"] and "bold" in dom.extract(HTML, "css", ["article.main-text"])["text"]
    assert "main content" in dom.extract(HTML, "xpath", ["//main[@role='main']"])["text"] and dom.extract(HTML, "xpath", ["//article/p[2]"], least=5)["text"] == "Second bold paragraph & more"
    assert dom.extract(HTML, "odd")["error"] and dom.extract("", "auto")["text"] == ""
    doc = dom.parse("<div><div>x</div></div>")
    assert len(dom.select(doc, "div div")) == 3 and len(dom.xpath(doc, "/html/body/div/div")) == 1
    assert dom.first_title(dom.parse(HTML)) == "First"


def test_density_without_landmarks():
    page = "<body><div class=menu>" + "<a href=x>link text</a>" * 40 + "</div><div id=c><p>" + "real words here. " * 30 + "</p></div></body>"
    assert dom.extract(page)["text"].startswith("real words") and "link text" not in dom.extract(page)["text"]


def test_profiles_and_sanitising():
    d = dom.parse(HTML)
    assert dom.skeleton(dom.parse("<p>a<br>b")) == "0:html;1:head;1:body;2:p;3:br;" and len(dom.fingerprint(d)) == 32
    assert [x["tag"] for x in dom.landmarks(d)] == ["nav", "main", "article", "aside", "footer"]
    clean = dom.sanitise('<p onclick=x>a<script>b</script><a href="javascript:x">c</a><img src=i alt=t style=q></p>')
    assert "script" not in clean and "onclick" not in clean and 'src="i"' in clean and "style" not in clean
    assert dom.to_markdown("<h2>T</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x<li>y</ul>") == "## T\n\na **b** [l](u)\n\n- x\n- y"
    assert not dom.sufficient("<body><div id=\"root\"></div>" + " " * 300) and not dom.sufficient("short") and dom.sufficient("<body><p>" + "many words of text " * 30)
    assert "secret" not in dom.visible_text(dom.parse("<p>a</p><div style='display:none'>secret</div>"))


RSS = '<?xml version="1.0"?><rss version="2.0" xmlns:dc="d" xmlns:content="c"><channel><title>Tech News</title><item><guid>item-001</guid><title> A </title><link>l1</link><author>me</author></item><item><title>B</title><link>l2</link><dc:creator>you</dc:creator><content:encoded>body</content:encoded></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>A</title><link rel="self" href="s"/><link rel="alternate" href="x"/><published>p</published></entry><entry><title>B</title><link href="y"/><updated>u</updated><author><name>n</name></author></entry></feed>'


def test_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("x", "<html/>"), ("e", ""), ("d", "<rdf><channel/></rdf>"), ("b", "<rss><channel>")], "doc string, body string")
    rows = feeds.read_feeds(df).orderBy("doc", "position").collect()
    got = {(r.doc, r.position): r for r in rows}
    assert (got["r", 0].guid, got["r", 0].author, got["r", 1].guid, got["r", 1].author, got["r", 1].content) == ("item-001", "me", "l2", "you", "body")
    assert (got["a", 0].link, got["a", 1].guid, got["a", 1].published, got["a", 1].author) == ("x", "y", "u", "n")
    assert all(got[k, None].error for k in "xedb") and feeds.read_feeds(df, most=1).where("error is null").count() == 2


def test_api(spark):
    df = spark.createDataFrame([("1", '[{"title":"a","text":null,"url":3},7]'), ("2", '{"web":{"results":[{"name":"n","link":"u"}]}}'), ("3", "{"), ("4", "{}")], "doc string, body string")
    got = {r.doc: r for r in feeds.read_api(df).collect()}
    assert (got["1"].title, got["1"].text, got["1"].url) == ("a", "", "3") and got["2"].error and got["3"].error
    got = [r for r in feeds.read_api(df, "web.results", {"title": "name", "url": "link"}).collect() if not r.error]
    assert [(r.title, r.text, r.url) for r in got] == [("n", "", "u")]
    assert [feeds.as_string(x) for x in (1e6, 1.5, 1e21, True, [1, None], {"b": 1, "a": "x"}, 1e-5, 12345678)] == ["1e+06", "1.5", "1e+21", "true", "[1 <nil>]", "map[a:x b:1]", "1e-05", "1.2345678e+07"]
    assert feeds.expand_env("a $X ${Y} $Z", {"X": "1", "Y": "2"}) == "a 1 2 "


def test_github_items(spark):
    df = spark.createDataFrame([("c", '[{"sha":"s","commit":{"message":"first\\nmore"},"html_url":"u"},{"sha":""}]', "commits"), ("i", '[{"number":7,"title":"T","labels":[{"name":"bug"}],"body":"B"}]', "issues"), ("r", '[{"tag_name":"v1","name":""}]', "releases")], "doc string, body string, resource string")
    got = {r.doc: r for r in feeds.github_items(df).collect()}
    assert (got["c"].title, got["i"].item_key, got["i"].text, got["r"].title) == ("first", "7", "T\n\nLabels: bug\n\nB", "v1")


def _zip(name, body):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, body)
    return b.getvalue()


def test_files(spark):
    docx = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    odt = '<o xmlns:t="t"><t:h t:outline-level="3">H</t:h><t:list><t:p>item</t:p></t:list><t:p>para</t:p></o>'
    pdf = b"%PDF-1.4\n1 0 obj <</Length 9>> stream\nBT (Hello \\(x\\)) Tj\n0 -1 Td\n(World) Tj\nT*\n(Two) Tj ET Tj\nendstream endobj /Subtype /Image"
    rows = [("a.docx", _zip("word/document.xml", docx)), ("b.odt", _zip("content.xml", odt)), ("c.md", b"# My Title\ntext\nmore\n\n## Section Two\nend"), ("d.txt", b"x  y\nz"), ("e.html", HTML.encode()), ("f.pdf", pdf), ("g.xyz", b""), ("h.docx", b"no zip")]
    got = {r.path: r for r in files.read_documents(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"].title == "Head" and [(s.kind, s.text, s.level) for s in got["a.docx"].sections] == [("heading", "Head", 2), ("paragraph", "Some text", 0)] and got["a.docx"].raw_text == "Head\nHead\nSome text"
    assert [s.kind for s in got["b.odt"].sections] == ["heading", "list", "paragraph"] and got["c.md"].title == "My Title" and [s.text for s in got["c.md"].sections] == ["My Title", "text more", "Section Two", "end"]
    assert got["d.txt"].title == "x y z" and got["e.html"].title == "First" and "Hello (x) World" in got["f.pdf"].raw_text and got["f.pdf"].has_images and got["g.xyz"].error and got["h.docx"].error
    q = files.pdf_quality(files.read_documents(spark.createDataFrame(rows, "path string, content binary"))).first()
    assert q.page_count == 1 and q.needs_ocr is True
    assert [one(spark, files.format_of("t"), t=t) for t in ("a.DOCX", "x/y.markdown", "z.htm", "q", "w.exe")] == ["docx", "md", "html", None, None]
    assert [files.heading_level(s) for s in ("Title", "Subtitle", "Heading 3", "Titre1", "Überschrift6", "Normal")] == [1, 2, 3, 1, 6, 0]


def test_vectors(spark):
    c = lambda a, b: one(spark, vectors.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))) if a and b else F.lit(0.0), t="")
    assert c([1.0, 0.0], [2.0, 0.0]) == 1 and c([1.0, 0.0], [0.0, 3.0]) == 0 and c([1.0], [1.0, 2.0]) == 0 and c([0.0], [1.0]) == 0
    df = spark.createDataFrame([(i, [float(i % 3), float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    back = df.withColumn("b", vectors.to_bytes("embedding")).withColumn("v", vectors.from_bytes("b")).collect()
    assert all(r.v == r.embedding and len(r.b) == 12 for r in back)
    assert vectors.nearest(df, [2.0, 5.0, 1.0], 3).first().vec_id == 5 and 5 not in [r.vec_id for r in vectors.similar_to(df, 5, 4).collect()] and vectors.similar_to(df, 99).count() == 0
    assert vectors.id_bytes("ff00") == b"\xff\x00" and vectors.id_bytes("xyz") == b"xyz"
    assert vectors.zero_embedder(spark.range(1), 4).first().embedding == [0.0] * 4


def test_sinks(spark, tmp_path):
    rows = [("e1", "s", "d", "u", "web", "Article: special", 0, "h", "body\nline")]
    x = spark.createDataFrame(rows, "id string, source_id string, dossier_id string, source_url string, source_type string, title string, extracted_at long, content_hash string, text string")
    f = sinks.markdown_files(x).first()
    assert f.name == "e1.md" and f.content == '---\nid: e1\nsource_id: s\ndossier_id: d\nsource_url: u\nsource_type: web\ntitle: "Article: special"\nextracted_at: 1970-01-01T00:00:00Z\ncontent_hash: h\n---\n\nbody\nline'
    sinks.write_markdown(x, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out", wholetext=True).count() == 1
    batch = spark.createDataFrame([("b", "u", "p", 42, [("insert", "/x", 1, "p", "", "", "", "<p>")], 1708700000000, None)], sinks.BATCH)
    assert sinks.read_envelopes(sinks.envelopes(batch, "batch"), "batch", sinks.BATCH).collect() == batch.collect()
    seen = []
    router = sinks.Router(lambda df: seen.append(1), lambda df: 1 / 0, None, lambda df: seen.append(2))
    with pytest.raises(ZeroDivisionError):
        router.send(batch)
    assert seen == [1, 2]
    domains = spark.createDataFrame([("a.com", 2, 0.85, 150, 3)], "domain string, profile_count long, avg_success_rate double, total_uses long, total_repairs long")
    instances = spark.createDataFrame([("i", 0, 0, 0)], "instance_id string, corrections_accepted long, corrections_rejected long, last_active long")
    page = sinks.leaderboard_page(domains, instances)
    assert 'badge good">85%' in page and 'badge warn">—' in page


def test_seeds(spark):
    assert seeds.sources(spark).count() == 15 and seeds.categories(spark).count() == 5 and seeds.engines(spark).count() == 4 and seeds.sources(spark, "tech").count() == 6
    stored = seeds.sources(spark).select("name", "url").limit(3)
    assert seeds.populate(stored, seeds.sources(spark).select("name", "url"), "url").count() == 15


def test_pages_of_any_depth():
    from tidemark.functions import dom

    deep = "<html><body>" + "<div class='c'><b>" * 4000 + "text of some words that say enough to be read as content " * 10 + "<a href='x'>link</a>" + "</b></div>" * 4000 + "</body></html>"
    doc = dom.parse(deep)
    assert len(dom.render(doc)) > 50_000 and dom.link_text(doc) == "link" and dom.skeleton(doc).count(";") > 8000
    assert dom.sanitise(deep).count("<div>") == 4000 and "text of some words" in dom.to_markdown(deep)
    assert "text of some words" in dom.extract(deep)["text"] and dom.profile(deep)["sufficient"] is False


def test_sizes_are_those_of_the_texts():
    from tidemark.functions import dom

    doc = dom.parse("<main> one <a href='u'>two <b>three</b></a><script>x < y</script><p>é &amp; f<br><img src='i'></p></main><div>last</div>")
    for n in doc.elements():
        if n.tag != "#document":
            text, links, trimmed, shown = dom.sizes(doc)[id(n)]
            assert (text, links, shown) == (dom.bytes_of(dom.text_of(n)), dom.bytes_of(dom.link_text(n)), dom.bytes_of(dom.render(n))), n.tag
            assert (trimmed, max(0, shown - trimmed)) == dom.split_bytes(n)


def test_hidden_styles():
    from tidemark.functions import dom

    hidden = lambda s: dom.is_hidden(dom.Node("div", [("style", s)]))
    assert hidden("DISPLAY : none") and hidden("visibility:hidden") and hidden("font-size:0;") and hidden("font-size:0px") and hidden("opacity:0;") and hidden("position:absolute;left:0") is False
    assert hidden("position: absolute left:-9999px") and not hidden("opacity:0.5") and not hidden("position:absolute;left:-9999px") and not hidden("font-size:01")
