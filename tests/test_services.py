"""Services over a store, configuration, and the snapshot, profile and level rules of streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.services import NotFound, Services
from tidemark.operators.tables import Store
from tidemark.sources import config
from tidemark.streaming import mutations


@pytest.fixture()
def ask(spark, tmp_path):
    now = [1_700_000_000_000]

    def clock():
        now[0] += 1
        return now[0]

    s = Services(Store(spark, f"file://{tmp_path}/s"), clock)
    return lambda service, **payload: json.loads(s.call(service, json.dumps({"dossier_id": "a", **payload} if service not in ("overview", "extract_html", "detect_format", "formats") else payload)))


def test_sources_and_questions(ask):
    sid = ask("add_source", name="n", url="https://e.com/feed/")["id"]
    assert ask("add_source", name="n", url="HTTPS://e.com/feed#x") == {"errors": ["duplicate"]}
    assert ask("list_sources")[0]["url"] == "https://e.com/feed"
    got = ask("update_source", id=sid, name="other")
    assert (got["name"], got["enabled"], got["config_json"]) == ("other", False, "")
    qid = ask("add_question", text="what is new")["id"]
    assert [q["text"] for q in ask("list_questions")] == ["what is new"] and ask("question_results", id=qid) == [] and len(ask("list_sources")) == 2
    ask("reset_source", id=sid)
    ask("delete_source", id=sid)
    assert len(ask("list_sources")) == 1 and {r["what"]: r["rows"] for r in ask("stats")}["sources"] == 1
    assert ask("search", query="nothing") == [] and ask("history", source_id=sid) == [] and ask("overview") == []
    with pytest.raises(NotFound):
        ask("no_such_service")


def test_registry(ask):
    ask("publish_profile", url_pattern="https://a.com/*", domain="a.com", extractors="v1", trust_level="community")
    p = ask("publish_profile", url_pattern="https://a.com/*", id="another", domain="a.com", extractors="v2", trust_level="community")
    assert (p["id"], p["extractors"]) == ("https://a.com/*", "v2") and ask("get_profile", key="https://a.com/*")["domain"] == "a.com"
    with pytest.raises(NotFound):
        ask("get_profile", key="zz")
    assert len(ask("search_profiles", domain="a.com")) == len(ask("search_profiles", trust_level="community")) == 1 and ask("search_profiles", domain="b") == []
    for i in range(3):
        c = ask("submit_correction", profile_id=p["id"], instance_id="i", new_extractors=f"c{i}")
        assert c["accepted"] is False and ask("accept_correction", id=c["id"])["validated"] == 1
    assert ask("submit_correction", profile_id=p["id"], instance_id="i", new_extractors="auto")["accepted"] is True
    c = ask("submit_correction", profile_id=p["id"], instance_id="j", new_extractors="no")
    assert ask("reject_correction", id=c["id"])["validated"] == -1
    got = ask("get_profile", key=p["id"])
    assert (got["extractors"], got["total_repairs"]) == ("auto", 4)
    assert ask("leaderboard")[0]["domain"] == "a.com" and ask("leaderboard", type="instance")[0]["corrections_accepted"] == 4


def test_vectors_documents_and_tiers(ask):
    assert ask("vector_insert", rows=[{"id": f"v{i}", "vector": [i, 1, 0]} for i in range(5)]) == {"inserted": 5, "count": 5}
    assert ask("vector_search", vector=[4, 1, 0], top_k=2, ef_search=9)[0]["ext_id"] == "v4" and ask("vector_stats")[0]["count"] == 5
    assert ask("extract_html", html="<title>T</title><article>" + "x y " * 30 + "</article>")["title"] == "T" and ask("detect_format", name="a.MD") == {"format": "md"} and len(ask("formats")) == 6
    assert ask("tiered_search", query="a b c", tier="premium") == [] and ask("tier_stats")[0]["searches"] == 1


def test_rules_costs_sweeps_and_failures(ask):
    rule = ask("add_rule", name="r", url_pattern="https://a.com/*", priority=3)
    assert (rule["extract_mode"], rule["trust_level"], rule["enabled"]) == ("auto", "unverified", True) and [r["id"] for r in ask("list_rules", enabled_only=True)] == [rule["id"]]
    assert ask("cost", backlog=10)["threshold"]["decision"] == "serverless" and ask("cost")["pricing"] == []
    sid = ask("add_source", name="n", url="https://e.com/p")["id"]
    assert ask("fetch_now", id=sid, answer={"status": 503, "error": "http 503"}) == {"extracted": 0, "status": "error"}
    assert ask("sweep", probes=[{"id": sid, "status_code": 200}]) == {"probed": 1, "recovered": 1} and ask("list_sources")[0]["last_status"] == "pending"
    page = "<title>T</title><article>" + "some words of a page " * 10 + "</article>"
    assert ask("fetch_now", id=sid, answer={"body": page}) == {"extracted": 1, "status": "ok"} and ask("fetch_now", id=sid, answer={"body": page}) == {"extracted": 0, "status": "unchanged"}
    assert [r["title"] for r in ask("search", query="words")] == ["T"] and len(ask("history", source_id=sid)) == 3
    ask("publish_profile", url_pattern="p", id="p", domain="d")
    assert ask("report_failure", profile_id="p", message="m")["success_rate"] == pytest.approx(0.95)
    with pytest.raises(NotFound):
        ask("report_failure", profile_id="zz")


def test_documents_and_vectors_as_services(spark, tmp_path):
    import base64

    s = Services(Store(spark, f"file://{tmp_path}/s"), lambda: 1)
    got = json.loads(s.call("extract_document", json.dumps({"name": "a.md", "content": base64.b64encode(b"# Head\ntext").decode()})))
    assert got["format"] == "md" and "text" in got["raw_text"]
    assert json.loads(s.call("embed", json.dumps({"texts": ["a", "b"]}))) == [[0.0] * 768] * 2


def test_overview_is_whole_and_pages_by_id(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    shards = spark.range(1200).selectExpr("'n' AS name", "'active' AS status", "concat('t', lpad(id, 5, '0')) AS dossier_id")
    from tidemark.operators import aggregates

    s = Services(store, lambda: 1)
    store.overview = lambda: aggregates.counts_by_shard(shards, {})
    assert len(s.do_overview()) == 1200 and [r["dossier_id"] for r in s.do_overview(after="t01197")] == ["t01198", "t01199"]
    assert [r["dossier_id"] for r in s.do_overview(limit=2)] == ["t00000", "t00001"]


def test_config():
    c = config.load('{"debounce": {"window_ms": 0, "max_buffer": 5}, "pages": [1]}')
    assert c["debounce"] == {"window_ms": 250, "max_buffer": 5} and c["pages"] == [1] and c["browser"]["stealth"] == "auto"
    seen = iter([1, 1, 2, 3, 3, 3, 3, 3, 3])
    assert next(config.poll(lambda: next(seen), sleep=lambda s: None)) == 3


def test_settling_and_snapshots(spark):
    r = spark.createDataFrame([("p", t) for t in (100, 300, 900, 5000, 5200)] + [("q", 10)], "page_id string, ts_ms long")
    n = spark.createDataFrame([("p", 0), ("p", 4900), ("p", 5100), ("z", 7)], "page_id string, ts_ms long")
    assert sorted(tuple(x) for x in mutations.settled(r, n).collect() if x.settled) == [("p", 0, 800), ("p", 5100, 5700), ("z", 7, 507)]
    pages = spark.createDataFrame([("a", "active", None, None), ("b", "active", None, 5), ("c", "active", 10, 5), ("d", "off", None, None)], "id string, status string, snapshot_interval_ms long, last_snapshot_at long")
    assert sorted(x.id for x in mutations.snapshot_times(pages, 100).collect()) == ["a", "c"]


def test_profiles_and_levels(spark):
    rules = spark.createDataFrame([("r", "https://known/*", 1, "", True)], "id string, url_pattern string, priority int, page_id string, enabled boolean")
    p = spark.createDataFrame([("https://known/a", ["main"], "{}"), ("https://new/a", ["article"], "{}"), ("https://bare/a", [], "{}")], "page_url string, content_selectors array<string>, profile_json string")
    made, pages = mutations.consume_profiles(p, rules, 5)
    assert [(r.url_pattern, r.extract_mode, r.selectors) for r in made.collect()] == [("https://new/a", "css", ["article"])] and pages.count() == 3
    levels = spark.createDataFrame([("auto", True), ("auto", False), ("2", None)], "l string, ok boolean").select(mutations.stealth_level(F.col("l"), F.col("ok")).alias("x"))
    assert [r.x for r in levels.collect()] == [0, 1, 2]
