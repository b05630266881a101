"""The store, handlers, and live HTTP against a server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import nodes
from tidemark.operators import handlers, tables
from tidemark.schemas import TABLES
from tidemark.sources import http, sinks

NOW = 1_700_000_000_000


@pytest.fixture()
def store(spark, tmp_path):
    return tables.Store(spark, f"file://{tmp_path}/store")


def new_sources(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, name string, url string, source_type string, fetch_interval long, config_json string")


def test_tenants_and_versions(spark, store):
    a, b = store.of("a"), store.of("b")
    assert a.add_sources(new_sources(spark, ("s1", "one", "https://e.com/", "web", 0, ""), ("s2", "two", "bad url", "web", 0, "")), NOW).count() == 1
    b.add_sources(new_sources(spark, ("s1", "other", "https://e.com", "web", 0, "")), NOW)
    assert a.get("sources", "id", "s1")["url"] == "https://e.com" and b.get("sources", "id", "s1")["name"] == "other" and a.get("sources", "id", "zz") is None
    for s, word in ((a, "quantum"), (b, "blockchain")):
        s.append("extractions", [{"id": "x", "source_id": "s1", "content_hash": "h", "title": word, "extracted_text": f"all about {word}", "url": "u", "extracted_at": NOW}])
    assert a.search("quantum", NOW).count() == 1 and a.search("blockchain", NOW).count() == 0 and b.search("blockchain", NOW).count() == 1
    assert a.read("search_log").count() == 2 and {r.what: r.rows for r in a.stats().collect()} == {"sources": 1, "extractions": 1, "fetch_log": 0}
    a.delete_source("s1")
    assert a.read("extractions").count() == 0 and b.read("extractions").count() == 1 and store.all_tenants("sources").count() == 1


def test_questions_chunks_and_content(spark, store):
    s = store.of("a")
    q = spark.createDataFrame([("q1", "what is new", None, None, "[]", True)], "id string, text string, schedule_ms long, max_results int, channels string, enabled boolean")
    s.add_questions(q, NOW)
    assert s.get("sources", "id", "q1")["url"] == "question://q1" and s.get("tracked_questions", "id", "q1")["max_results"] == 20
    s.append("extraction_rules", [{"id": "r", "trust_level": "official", "folder_id": "f", "enabled": True}])
    s.append("content_cache", [{"id": "c", "rule_id": "r", "title": "Test", "page_url": "u"}])
    s.append("chunks", [{"id": "k2", "content_id": "c", "chunk_index": 1, "text": "Machine learning algorithms"}, {"id": "k1", "content_id": "c", "chunk_index": 0, "text": "Quantum computing is new"}])
    hit = s.search_chunks("quantum computing").collect()
    assert [(r.id, r.title) for r in hit] == [("k1", "Test")] and s.search_chunks("quantum", trust="community").count() == 0 and s.search_chunks("quantum", ["f"], "official").count() == 1
    assert [c["id"] for c in s.content("c")["chunks"]] == ["k1", "k2"]
    assert cli.main([store.path, "--dossier", "a", "--search", "quantum"]) == 0 and cli.main([store.path]) == 0


RSS = "<rss><channel><item><guid>g1</guid><title>T</title><description>some words</description></item><item><guid>g2</guid><title>U</title></item></channel></rss>"
PAGE = "<title>P</title><article><p>" + "good content here " * 10 + "</p></article>"


def test_process(spark):
    rows = [("w", "web", "{}"), ("r", "rss", "{}"), ("j", "api", '{"result_path":"d","fields":{"title":"n","text":"t","url":"u"}}'), ("d", "document", "{}"), ("e", "web", "{}"), ("p", "odd", "{}"), ("b", "rss", "{}")]
    kinds = TABLES["sources"]
    full = [(i, i, f"https://x/{i}" + (".md" if i == "d" else ""), t, 3_600_000, True, c, None, "", "pending", "", 0, None, 0, 0) for i, t, c in rows]
    s = spark.createDataFrame(full, kinds)
    answers = spark.createDataFrame([("w", 200, PAGE, None), ("r", 200, RSS, None), ("j", 200, '{"d":[{"n":"a","t":"body","u":"x"},{"n":"b","t":" "}]}', None), ("d", 200, "# Head\ntext", None), ("e", 503, None, "http 503"), ("p", 200, PAGE, None), ("b", 200, "<html/>", None)], "id string, status int, body string, error string")
    stored = spark.createDataFrame([], TABLES["extractions"])
    after, new, log = handlers.process(s, answers, stored, NOW)
    got = {r.id: r for r in after.collect()}
    assert {r.source_id for r in new.collect()} == {"w", "r", "j", "d", "p"} and new.count() == 6 and log.count() == 7
    assert got["w"].last_status == "ok" and got["e"].last_status == "error" and got["e"].fetch_interval == 7_200_000 and got["e"].fail_count == 1 and got["b"].last_error.startswith("feed")
    again, none, _ = handlers.process(after, answers, stored.unionByName(new.select("source_id", "content_hash"), allowMissingColumns=True), NOW + 1)
    assert none.count() == 0 and {r.id: r.last_status for r in again.collect()}["w"] == "unchanged"


def test_registry_and_results(spark):
    r = handlers.registry({"web_fetch": None, "github_fetch": handlers.rss, "other": handlers.rss})
    assert r["web"] is handlers.web and "github" in r and "other" not in r
    found = spark.createDataFrame([("q", 0, i, f"t{i}", "x", f"u{i % 2}") for i in range(5)], "question_id string, engine_position int, position int, title string, text string, url string")
    q = spark.createDataFrame([("q", 3)], "id string, max_results int")
    assert handlers.results(found, q).count() == 3


class Handler(BaseHTTPRequestHandler):
    posted: list = []
    fails = 1

    def _send(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_GET(self):  # noqa: N802
        if self.path == "/ok":
            self._send(200, PAGE.encode(), ETag="e1", Last_Modified="yesterday")
        elif self.path == "/move":
            self._send(302, Location="/ok")
        elif self.path == "/json":
            self._send(200, json.dumps([{"title": self.headers.get("X-Key", "")}]).encode())
        else:
            self._send(404)

    do_HEAD = do_GET  # noqa: N815

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/hook":
            Handler.fails -= 1
            Handler.posted.append(body)
            return self._send(500 if Handler.fails >= 0 else 200)
        data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"]) if t != "lost"]
        return self._send(200, json.dumps({"data": data[::-1]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch_and_probe(spark, server):
    df = spark.createDataFrame([("a", f"{server}/ok", ""), ("b", f"{server}/none", ""), ("c", "http://127.0.0.1:9", ""), ("d", f"{server}/move", "")], "id string, url string, last_hash string")
    got = {r.id: r for r in http.fetch_sources(df, 2).collect()}
    assert got["a"].changed and got["a"].etag == "e1" and got["b"].error == "http 404" and got["c"].status == 0 and got["c"].error and got["d"].body == PAGE
    assert not http.fetch(f"{server}/ok", previous=got["a"].hash)["changed"] and http.fetch(f"{server}/ok", allowed=lambda u: False)["error"]
    probed = {r.id: r.status_code for r in http.probe(df).collect()}
    assert (probed["a"], probed["b"], probed["c"]) == (200, 404, 0)
    snap = http.snapshots(df.withColumnRenamed("id", "page_id")).where("page_id = 'b'").first()
    assert snap.html == "" and not snap.sufficient
    api = spark.createDataFrame([("q", f"{server}/json", "", {"X-Key": "${NOT_SET}k"})], "doc string, url string, method string, headers map<string,string>")
    assert json.loads(http.call_apis(api).first().body) == [{"title": "k"}]


def test_embeddings_and_webhook(spark, server):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "lost", None])], "id int, text string").coalesce(1)
    got = {r.id: r for r in http.embed(df, f"{server}/embed", batch=2).collect()}
    assert got[1].embedding == [2.0, 1.0] and got[2].error and got[3].embedding == [0.0, 1.0]
    http.webhook(f"{server}/hook", "batch", wait=0.01)(spark.createDataFrame([(1,)], "id int").coalesce(1))
    assert Handler.posted[-1] == {"type": "batch", "data": {"id": 1}} and len(Handler.posted) == 2
    with pytest.raises(OSError):
        http.webhook("http://127.0.0.1:9", "batch", retries=0)(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(OSError):
        sinks.Router(http.webhook("http://127.0.0.1:9", "x", retries=0)).send(spark.range(1))


def test_node_map(spark):
    m = nodes.NodeMap()
    m.insert(1, "html")
    m.insert(2, "div", 1)
    m.insert(3, "div", 1)
    m.insert(4, "p", 3)
    m.insert(5, "b", 2, shadow=True)
    assert (m.path(2), m.path(3), m.path(4), m.path(5), m.path(99)) == ("/html/div", "/html/div[2]", "/html/div[2]/p", "/html/div/shadow-root/b", "/unknown[nodeId=99]")
    m.remove(3)
    assert m.path(4) == "/unknown[nodeId=4]" and m.children[1] == [2]
    rows = spark.createDataFrame([("<p>a<p>b",)], "h string").select(F.explode(nodes.nodes_column("h")).alias("n")).select("n.*").collect()
    assert [r.xpath for r in rows] == ["/html", "/html/head", "/html/body", "/html/body/p[1]", "/html/body/p[2]"]


def test_appends_leave_files_alone_and_searches_read_buckets(spark, store, tmp_path):
    import pathlib

    a, b = store.of("a"), store.of("b")
    rows = lambda *words: [{"id": w, "source_id": "s", "content_hash": w, "title": w, "extracted_text": f"all about {w} and more", "url": "u", "extracted_at": NOW} for w in words]
    a.append("extractions", rows("quantum", "fields"))
    before = set(pathlib.Path(tmp_path / "store").rglob("*.parquet"))
    b.append("extractions", rows("other"))
    a.append("extractions", rows("quantum2", "waves"))
    assert before <= set(pathlib.Path(tmp_path / "store").rglob("*.parquet"))
    assert [r.id for r in a.search("waves", NOW).collect()] == ["waves"] and a.search("other", NOW).count() == 0
    assert sorted(r.id for r in a.search("quant* NOT fields", NOW).collect()) == ["quantum", "quantum2"]
    from tidemark.operators import search

    plan = search.bm25_index(a.postings("extractions"), "waves", "id", ("title", "extracted_text"), buckets=tables.INDEX_BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]
    a.remove("extractions", F.col("id") == "waves")
    assert a.search("waves", NOW).count() == 0 and a.search("about", NOW).count() == 3 and b.search("about", NOW).count() == 1
    store.write("extractions", store.all_tenants("extractions").where("dossier_id = 'b'"))
    assert a.read("extractions").count() == 0 and a.search("about", NOW).count() == 0 and b.search("about", NOW).count() == 1


def test_index_ranks_as_the_texts_do(spark):
    import random

    from tidemark.operators import search

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "alps", "été", "Ete"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    df = spark.createDataFrame([(i, make(rng.randint(0, 3)) or None, make(rng.randint(0, 12))) for i in range(80)], "id long, title string, body string")
    postings = search.index(df, "id", ("title", "body"), buckets=4).cache()
    for q in ("alpha", "alpha beta", '"alpha beta"', "al*", '"beta al*"', "alpha NOT beta", "(alpha OR delta) AND ete", "title:alpha", "NEAR(alpha delta, 2)", "alpha + beta gamma", "NEAR(alpha gamma beta, 1) OR title:ete"):
        want = {r.id: round(r.rank, 9) for r in search.bm25(df, q, "id", ("title", "body"), limit=None).collect()}
        got = {r.id: round(r.rank, 9) for r in search.bm25_index(postings, q, "id", ("title", "body"), limit=None, buckets=4).collect()}
        assert got == want, q
    assert search.bm25_index(postings, "alpha", "id", ("title", "body"), limit=3, offset=2, buckets=4).collect() == search.bm25(df, "alpha", "id", ("title", "body"), limit=3, offset=2).collect()
    with pytest.raises(search.QueryError):
        search.bm25_index(postings, "nope:alpha", "id", ("title",), buckets=4)
