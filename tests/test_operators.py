"""State, joins, search, aggregates and streams on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import joins, search, state
from tidemark.streaming import mutations

NOW = 1_000_000_000
SOURCE = "id string, name string, url string, source_type string, fetch_interval long, enabled boolean, config_json string, last_fetched_at long, last_hash string, last_status string, last_error string, fail_count int, original_fetch_interval long, created_at long, updated_at long"


def sources(spark, *rows):
    base = {"name": "n", "url": None, "source_type": "web", "fetch_interval": 3_600_000, "enabled": True, "config_json": "{}", "last_fetched_at": None, "last_hash": "", "last_status": "ok", "last_error": "", "fail_count": 0, "original_fetch_interval": None, "created_at": 0, "updated_at": 0}
    names = [x.split()[0] for x in SOURCE.split(", ")]
    return spark.createDataFrame([[({**base, "url": f"https://{r['id']}.example.com"} | r)[n] for n in names] for r in rows], SOURCE)


def ids(df):
    return [r.id for r in df.collect()]


def test_due_and_broken(spark):
    s = sources(spark, {"id": "due", "last_fetched_at": NOW - 7_200_000}, {"id": "fresh", "last_fetched_at": NOW}, {"id": "new"}, {"id": "off", "enabled": False}, {"id": "failing", "fail_count": 10})
    assert ids(state.due_sources(s, NOW, 5)) == ["new", "due"]
    s = sources(spark, {"id": "ok"}, {"id": "err", "last_status": "error", "fail_count": 1}, {"id": "b", "last_status": "broken", "fail_count": 5}, {"id": "p", "last_status": "pending"}, {"id": "x", "last_status": "extract_error"})
    assert ids(state.broken_sources(s)) == ["b", "err", "x"]


def test_backoff_reset_and_moves(spark):
    s = sources(spark, {"id": "a"})
    every = F.lit(True)
    for want in (7_200_000, 14_400_000):
        s = state.backoff(s, every, NOW)
        r = s.first()
        assert (r.fetch_interval, r.original_fetch_interval) == (want, 3_600_000)
    assert state.backoff(s, every, NOW, 15_000_000).first().fetch_interval == 15_000_000
    r = state.reset(state.set_status(s, every, "broken", 1), every, NOW).first()
    assert (r.last_status, r.fail_count, r.fetch_interval, r.original_fetch_interval) == ("pending", 0, 3_600_000, None)
    r = state.move_url(sources(spark, {"id": "a", "fail_count": 5, "last_status": "error"}), every, F.lit("https://new"), NOW).first()
    assert (r.url, r.fail_count, r.last_status) == ("https://new", 0, "pending")
    r = state.fetch_error(s, every, F.lit("http 500"), NOW).first()
    assert (r.fail_count, r.last_status, r.last_error) == (1, "error", "http 500")
    r = state.fetch_success(state.fetch_error(s, every, F.lit("x"), NOW), every, F.lit("h"), NOW).first()
    assert (r.fail_count, r.last_hash, r.last_status) == (0, "h", "ok") and state.fetch_unchanged(s, every, NOW).first().last_status == "unchanged"


def test_repair(spark):
    s = sources(spark, *({"id": i} for i in "abcdef"), {"id": "g", "config_json": json.dumps({"user_agent": state.AGENTS[2], "tried_uas": state.AGENTS[:2]})}, {"id": "h", "config_json": '{"result_path":"a.b","n":1.5,"fields":{"title":"t","x":[1,null,true]},"user_agent":"x"}'}, {"id": "i", "config_json": "no json"})
    f = spark.createDataFrame([("a", 503, ""), ("b", 404, ""), ("c", 403, ""), ("d", 301, ""), ("e", 429, ""), ("g", 403, ""), ("h", 403, ""), ("i", 403, "")], "id string, status int, message string")
    got = {r.id: r for r in state.repair(s, f, NOW).collect()}
    assert got["a"].fetch_interval == got["e"].fetch_interval == 7_200_000 and got["b"].last_status == got["g"].last_status == "broken"
    assert json.loads(got["h"].config_json) == {"result_path": "a.b", "n": 1.5, "fields": {"title": "t", "x": [1, None, True]}, "user_agent": state.AGENTS[0], "tried_uas": ["x"]}
    assert json.loads(got["i"].config_json)["user_agent"] == json.loads(got["c"].config_json)["user_agent"] == state.AGENTS[0]
    assert got["c"].last_status == "ok" and got["d"] == s.where("id = 'd'").first() and got["f"].fetch_interval == 3_600_000


def test_add_and_merge(spark):
    s = sources(spark, {"id": "s", "url": "https://e.com/feed"})
    new = sources(spark, {"id": "1", "url": "HTTPS://E.com/feed/"}, {"id": "2", "url": "https://n.com", "fetch_interval": 0, "source_type": ""}, {"id": "3", "url": "https://n.com/#x", "created_at": 5}, {"id": "4", "url": "bad url"}, {"id": "5", "url": "https://m.com", "fetch_interval": 5})
    out, bad = state.add_sources(s, new, NOW)
    assert sorted(ids(out)) == ["2", "s"] and {r.id: r.errors for r in bad.collect()} == {"1": ["duplicate"], "3": ["duplicate"], "4": ["url required"], "5": ["interval out of range"]}
    r = out.where("id = '2'").first()
    assert (r.fetch_interval, r.source_type) == (3_600_000, "web")
    assert [r.errors for r in state.add_sources(s, new, NOW, most=1)[1].where("id = '2'").collect()] == [["quota"]]
    c = spark.createDataFrame([("s", "", "", "", 0, False, "")], "id string, name string, url string, source_type string, fetch_interval long, enabled boolean, config_json string")
    r = state.merge_source(s, c, NOW).first()
    assert (r.name, r.url, r.enabled, r.config_json, r.fetch_interval) == ("n", "https://e.com/feed", False, "", 3_600_000)


def test_url_migration_keeps_the_oldest(spark):
    s = sources(spark, {"id": "s1", "url": "https://example.com/feed", "created_at": 1}, {"id": "s2", "url": "HTTPS://Example.COM/feed/", "created_at": 2}, {"id": "s3", "url": "https://example.com/feed#section", "created_at": 3}, {"id": "q", "url": "not a url"})
    kept, gone = state.normalise_urls(s)
    assert sorted((r.id, r.url) for r in kept.collect()) == [("q", "not a url"), ("s1", "https://example.com/feed")] and sorted(ids(gone)) == ["s2", "s3"]


def test_delete_cascades_and_detaches(spark):
    s = sources(spark, {"id": "a"}, {"id": "b"})
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, source_id string")
    left, kids = state.delete(s, F.col("id") == "a", {"extractions": (child, "source_id")})
    assert ids(left) == ["b"] and sorted(r.n for r in kids["extractions"].collect()) == [2, 3]
    assert sorted((r.n, r.source_id) for r in state.detach(child, "source_id", s.where("id = 'a'")).collect()) == [(1, None), (2, "b"), (3, None)]


def test_questions(spark):
    q = spark.createDataFrame([("q", "x" * 79 + "éé" + "y" * 20, None, None, None, True), ("r", "short", 5, 3, '["e1","e0"]', True)], "id string, text string, schedule_ms long, max_results int, channels string, enabled boolean")
    got = {r.id: r for r in state.question_source(q, NOW).collect()}
    assert got["q"].name == "Q: " + "x" * 79 + "..." and got["q"].fetch_interval == 86_400_000 and got["r"].name == "Q: short" and got["r"].url == "question://r"
    e = spark.createDataFrame([("e0", "zero", True), ("e1", "one", True), ("e2", "two", False)], "id string, name string, enabled boolean")
    assert [(r.position, r.name) for r in joins.channels_to_engines(q, e).orderBy("position").collect()] == [(0, "one"), (1, "zero")]
    assert joins.lookup_chain(spark.createDataFrame([("e0",), ("e2",), ("zz",)], "id string"), e, e.withColumn("name", F.upper("name"))).orderBy("id").collect()[1].name == "TWO"
    runs = q.withColumns({"last_run_at": F.lit(None).cast("long"), "last_result_count": F.lit(0), "total_results": F.lit(4)})
    r = state.question_run(runs, F.col("id") == "r", F.lit(2), NOW).where("id = 'r'").first()
    assert (r.last_run_at, r.last_result_count, r.total_results) == (NOW, 2, 6) and state.due_questions(runs, NOW).count() == 2
    p = state.promote_search(spark.createDataFrame([("s", "find it", ["a"])], "id string, query string, channels array<string>"), NOW).first()
    assert (p.text, p.channels, p.schedule_ms, p.max_results) == ("find it", '["a"]', 86_400_000, 20)


def test_rules_and_content(spark):
    r = spark.createDataFrame([("r1", "https://example.com/*", 10, "", True), ("r2", "https://other.com/*", 5, "", True), ("r3", "*", 1, "", False), ("r4", "*", 2, "p1", True), ("r5", "http*page?", 3, "", True)], "id string, url_pattern string, priority int, page_id string, enabled boolean")
    p = spark.createDataFrame([("p0", "https://example.com/page1"), ("p1", "https://x.org/")], "page_id string, url string")
    m = joins.match_rules(p, r)
    assert sorted((x.page_id, x.r_id) for x in m.collect()) == [("p0", "r1"), ("p0", "r5"), ("p1", "r4")] and {x.page_id: x.r_id for x in joins.best_rule(m).collect()} == {"p0": "r1", "p1": "r4"}
    stored = spark.createDataFrame([("r1", "h1")], "rule_id string, content_hash string")
    new = spark.createDataFrame([("1", "r1", "h1"), ("2", "r1", "h2"), ("3", "r1", "h2"), ("4", "r2", "h1")], "id string, rule_id string, content_hash string")
    assert sorted(ids(state.insert_new(stored, new, "rule_id"))) == ["2", "4"]
    x = spark.createDataFrame([("a", 1, 5), ("b", 1, None), ("c", 0, 99)], "id string, version int, expires_at long")
    assert ids(x.where(state.expired(x, 50))) == ["a"] and state.rule_update(x.withColumn("updated_at", F.lit(0).cast("long")), x.where("id = 'a'").select("id", F.lit(7).cast("long").alias("expires_at")), NOW).where("id = 'a'").first().version == 2


def test_corrections_and_profiles(spark):
    c = spark.createDataFrame([(f"c{i}", "p", "i1", 1, i, f"e{i}") for i in range(3)] + [("c8", "p", "i2", 0, 8, "new")], "id string, profile_id string, instance_id string, validated int, created_at long, new_extractors string")
    rep = {r.instance_id: r for r in state.reputation(c).collect()}
    assert (rep["i1"].corrections_accepted, rep["i2"].corrections_pending, rep["i1"].last_active) == (3, 1, 2)
    new = spark.createDataFrame([("n1", "p", "i1", 0, 20, "x"), ("n2", "p", "nobody", 0, 21, "y")], c.schema)
    assert {r.id: r.validated for r in state.submit_corrections(c, new).collect() if r.id[0] == "n"} == {"n1": 1, "n2": 0}
    p = spark.createDataFrame([("p", "https://p/*", "old", 1.0, 0, 0, ["me"])], "id string, url_pattern string, extractors string, success_rate double, total_uses long, total_repairs long, contributors array<string>")
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    c2, p2 = state.decide(c, p, one("c8"), one("c0"))
    assert {r.id: r.validated for r in c2.collect()} == {"c0": 1, "c1": 1, "c2": 1, "c8": 1} and (p2.first().extractors, p2.first().total_repairs) == ("new", 1)
    every = F.lit(True)
    assert state.profile_failure(p, every).first().total_repairs == 1 and state.report_failure(p, every).first().total_repairs == 0
    assert state.profile_success(state.profile_failure(p, every), every).first().success_rate == pytest.approx(0.9525) and state.use_profile(p, every).first().total_uses == 1
    assert state.add_contributor(state.add_contributor(p, every, F.lit("you")), every, F.lit("me")).first().contributors == ["me", "you"]
    again = state.publish_profiles(p, p.withColumn("id", F.lit("q")).withColumn("extractors", F.lit("v2")))
    assert [(r.id, r.extractors) for r in again.collect()] == [("p", "v2")]


def test_leaderboards_and_costs(spark):
    p = spark.createDataFrame([("a.com", 0.9, 100, 1, 5), ("a.com", 0.8, 50, 2, 9), ("b.com", 0.5, 200, 0, 1)], "domain string, success_rate double, total_uses long, total_repairs long, updated_at long")
    top = agg.domain_leaderboard(p).collect()
    assert (top[0].domain, top[0].profile_count, round(top[0].avg_success_rate, 9), top[0].total_uses, top[0].last_updated) == ("a.com", 2, 0.85, 150, 9) and agg.domain_leaderboard(p, 1).count() == 1
    prices = spark.createDataFrame([("s", "active", False, 2.0, 0.0), ("d", "active", True, 1.0, 0.001), ("o", "old", False, 0.1, 0.0)], "id string, status string, is_dedicated boolean, cost_per_unit double, cost_per_sec double")
    r = agg.cost_decision(prices, 100.0).first()
    assert (r.serverless_cost, r.dedicated_cost, r.decision) == (200.0, 2592.0, "dedicated")
    r = agg.cost_decision(prices.limit(0), 100.0).first()
    assert (r.backlog_units, r.serverless_cost, r.dedicated_cost, r.decision) == (100.0, 0.0, 0.0, "serverless")
    z = spark.createDataFrame([("p", "nav")] * 3 + [("p", "main")] * 50, "page_id string, selector string")
    assert {r.selector: r.zone for r in agg.mutation_zones(z, 60.0).collect()} == {"nav": "mixed", "main": "dynamic"}
    assert agg.union_all([p, p], "shard", ["x", "y"]).groupBy("shard").count().count() == 2


DOCS = [(1, "Machine Learning Algorithms", "machine learning algorithms for classification"), (2, "NLP with Transformers", "natural language processing with transformers"), (3, "Computer Vision", "computer vision and image recognition tasks"), (4, "Éclair", "learning about a machine for crème")]


def test_search(spark):
    df = spark.createDataFrame(DOCS, "id int, title string, text string")
    find = lambda q: [r.id for r in search.bm25(df, q, "id", ("title", "text")).collect()]
    assert find("machine learning")[0] == 1 and set(find("machine learning")) == {1, 4} and find('"machine learning"') == [1] and find("eclair creme") == [4]
    assert find("trans*") == [2] and set(find("vision OR nlp")) == {2, 3} and find("machine NOT classification") == [4] and find("title:machine") == [1] and find("NEAR(natural processing, 1)") == [2] and find("NEAR(natural transformers, 1)") == []
    assert find("(vision OR nlp) image") == [3] and find("nothing") == [] and find("title : éclair") == [4]
    for bad in ("", '"', "(a", "a AND", "a OR OR b", "x-y", "NEAR(a, b)"):
        with pytest.raises(search.QueryError):
            search.parse(bad)


def test_tiers(spark):
    df = spark.createDataFrame(DOCS, "id int, title string, text string").withColumn("trust", F.when(F.col("id") == 4, "official").otherwise("unverified"))
    free = search.tiered(df, "machine learning", "id", ("text",)).collect()
    assert {r["pass"] for r in free} == {1} and [r.id for r in sorted(free, key=lambda r: r.place)][0] == 1
    rich = search.tiered(df, "machine learning", "id", ("text",), tier="premium", trust="trust").orderBy("place").collect()
    assert [r.id for r in rich] == [1, 4] and [round(r.score, 6) for r in rich] == [1.6, 1.3]
    assert search.variants("a b c") == ['"a b c"', "a", "b c"]
    index = search.postings(df, "id", "text")
    after = search.maintain(index, "id", "text", inserted=df.where("id = 1").withColumn("text", F.lit("brand new")), deleted=df.where("id = 2").select("id"))
    assert {r.term for r in after.where("doc = 1").collect()} == {"brand", "new"} and after.where("doc = 2").count() == 0
    assert [r.id for r in search.trust_order(df, ("id",), "trust").orderBy("place").collect()] == [1, 2, 3, 4]


REC = "page_id string, ts_ms long, n long, source string, xpath string, op string, name string, value string, old_value string"


def test_compression(spark):
    row = lambda n, op, v, old="", x="/p", name="class": ("p", n * 10, n, "js", x, op, name, v, old)
    df = spark.createDataFrame([row(1, "attr", "a", "orig"), row(2, "attr", "b", "a"), row(3, "attr", "c", "b"), row(4, "insert", "i"), row(5, "text", "t1", "t0"), row(6, "text", "t2", "t1"), row(7, "attr", "z", "c")], REC)
    got = mutations.compress(df, scope=("page_id",)).orderBy("n").collect()
    assert [(r.op, r.value, r.old_value) for r in got] == [("attr", "c", "orig"), ("insert", "i", ""), ("text", "t2", "t0"), ("attr", "z", "c")]
    same = spark.createDataFrame([row(i, "insert", str(i)) for i in range(3)], REC)
    assert mutations.compress(same, scope=("page_id",)).count() == 3
    q = mutations.quiet_batches(spark.createDataFrame([("p", t, i, "js", "/", "text", "", "", "") for i, t in enumerate([0, 100, 349, 600, 849, 1099])], REC))
    assert [r.batch for r in q.orderBy("n").collect()] == [1, 1, 1, 2, 2, 3]
    assert [r.batch for r in mutations.quiet_batches(q.drop("batch"), most=2).orderBy("n").collect()] == [1, 1, 2, 3, 3, 4]


def test_echoes_batch_and_stream(spark, tmp_path):
    rows = [("p", 0, 1, "js", "/a", "text", "", "", ""), ("p", 30, 2, "cdp", "/a", "text", "", "", ""), ("p", 60, 3, "cdp", "/a", "text", "", "", ""), ("p", 80, 4, "js", "/a", "text", "", "", ""), ("p", 500, 5, "cdp", "/b", "attr", "x", "", ""), ("q", 10, 6, "cdp", "/a", "text", "", "", "")]
    df = spark.createDataFrame(rows, REC)
    assert sorted(r.n for r in mutations.drop_echoes_batch(df).collect()) == [1, 3, 4, 5, 6]
    df.repartition(1).write.json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(REC).json(f"file://{tmp_path}/in")
    q = mutations.drop_echoes(stream).writeStream.format("memory").queryName("echoes").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("echoes").collect()) == [1, 3, 4, 5, 6]


def test_echoes_in_stretches_are_those_of_the_state(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice("pq"), rng.randrange(3000), i, rng.choice(["js", "cdp"]), rng.choice(["/a", "/b"]), "attr", rng.choice(["x", None]), None, None) for i in range(400)]
    want = []
    for group in {(r[0], r[4], r[6]) for r in rows}:
        held = []  # (time, source), as a page's memory has them
        for r in sorted((r for r in rows if (r[0], r[4], r[6]) == group), key=lambda r: r[1:3]):
            echo = any(s != r[3] and r[1] - t <= 50 for t, s in held)
            if not echo:
                held.append((r[1], r[3]))
            if not echo or r[3] == "js":
                want.append(r[2])
    assert len(want) < 400
    df = spark.createDataFrame(rows, REC)
    for stretch in (1, 40, 1000, 10**6):
        got = mutations.drop_echoes_batch(df, stretch=stretch)
        assert sorted(r.n for r in got.collect()) == sorted(want) and got.columns == df.columns
    assert not mutations.drop_echoes_batch(df.limit(0)).collect()


def test_stream_debounce_is_the_batch_form(spark, tmp_path):
    rows = [("p", t, i, "js", "/", "text", "", str(i), "") for i, t in enumerate([0, 100, 349, 700, 849])] + [("q", 0, 9, "js", "/", "text", "", "9", ""), ("z", 60_000, 99, "js", "/", "text", "", "", "")]
    df = spark.createDataFrame(rows, REC)
    df.repartition(1).write.json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(REC).json(f"file://{tmp_path}/in").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = []
    mutations.run_available(mutations.debounce(stream), lambda b, i: got.extend(b.select("page_id", F.size("records").alias("c")).collect()), f"file://{tmp_path}/cp")
    want = mutations.quiet_batches(df).groupBy("page_id", "batch").count().where("page_id <> 'z'").collect()
    assert sorted((r.page_id, r.c) for r in got if r.page_id != "z") == sorted((r.page_id, r["count"]) for r in want)


def test_consumers(spark):
    from tidemark.sources import sinks

    b = spark.createDataFrame([("b1", "u", "p1", 1, [("attr", "/", 1, "", "", "", "", "")], 10, None), ("b2", "u2", "p1", 2, [("insert", "/", 1, "", "", "", "", "")], 20, None)], sinks.BATCH)
    log, pages = mutations.consume_batches(b, NOW)
    assert {r.batch_id: r.kind for r in log.collect()} == {"b1": "minor", "b2": "significant"} and pages.first().page_url == "u2"
    old = pages.withColumn("created_at", F.lit(1)).withColumn("trust_level", F.lit("official"))
    r = mutations.upsert_pages(old, pages).first()
    assert (r.created_at, r.trust_level, r.page_url) == (1, "", "u2")
    html = "<article><p>" + "content words " * 20 + "</p></article>"
    s = spark.createDataFrame([("s1", "https://e.com/a", "p1", html, "h", 1), ("s2", "https://e.com/b", "p2", html, "h", 2), ("s3", "https://e.com/c", "p3", "<p>x", "h", 3)], sinks.SNAPSHOT)
    rules = spark.createDataFrame([("r", "https://e.com/*", 1, "", True, "auto", None)], "id string, url_pattern string, priority int, page_id string, enabled boolean, extract_mode string, selectors array<string>")
    stored = spark.createDataFrame([], "rule_id string, content_hash string")
    out = mutations.consume_snapshots(s, rules, stored).collect()
    assert len(out) == 1 and out[0].extracted_text.startswith("content words") and len(out[0].chunks) == 1
    assert mutations.consume_snapshots(s, rules, stored.unionByName(spark.createDataFrame([("r", out[0].content_hash)], stored.schema))).count() == 0
    chained = mutations.with_snapshots(b, s.withColumn("page_id", F.lit("p1")).withColumn("timestamp", F.lit(15))).orderBy("timestamp").collect()
    assert chained[0].snapshot_ref is None and chained[1].snapshot_ref in ("s1", "s2", "s3")


def test_interval_echoes_as_a_join(spark):
    df = spark.createDataFrame([("/a", 0, "js"), ("/a", 40, "cdp"), ("/a", 100, "cdp"), ("/b", 10, "cdp")], "xpath string, at long, source string")
    assert sorted((r.xpath, r.at) for r in joins.drop_echoes(df, ("xpath",), "at", "source", "cdp", "js").collect()) == [("/a", 0), ("/a", 100), ("/b", 10)]


def test_nest(spark):
    parent, child = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "fk int, pos int, t string")
    got = {r.id: [c.t for c in r.kids] for r in joins.nest(parent, child, "id", "fk", "pos", "kids").collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_moving_average_in_stretches(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(1000), i, rng.random() < 0.7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, n long, good boolean")
    for bucket in (1, 37, 10**6):
        got = {r.k: (r.success_rate, r.events) for r in state.ema_fold(df, "k", ("at", "n"), F.col("good"), start=0.4, bucket=bucket).collect()}
        for k in "ab":
            rate, mine = 0.4, sorted(r[1:] for r in rows if r[0] == k)
            for _, _, good in mine:
                rate = min(1.0, rate * 0.95 + 0.05) if good else max(0.0, rate * 0.95)
            assert got[k] == (pytest.approx(rate), len(mine))


def test_rules_with_hosts_open_classes_and_wildcards(spark):
    import re

    urls = ["https://www.a.com/x/1", "https://www.a.com/y", "https://www.b.org/x/1?q=2", "http://a.com", "ftp://z/[q", "https://www.a.com/[abc"]
    patterns = ["https://www.a.com/*", "https://www.a.com/x/[0-9]", "https://www.*", "*q=2", "https://www.a.com/[abc", "http://a.com", "*", "https://www.a.com/[^xy]*", "https://www.b.org/x/1[?]q*", "a(b", "https://www.a.com/[]x]*"]
    pages = spark.createDataFrame([(str(i), u) for i, u in enumerate(urls)], "page_id string, url string")
    rules = spark.createDataFrame([(p, p, "", True) for p in patterns], "id string, url_pattern string, page_id string, enabled boolean")

    def fits(p, u):
        from tidemark.functions.text import glob_regex

        return re.match(glob_regex(p), u) is not None

    want = sorted((u, p) for u in urls for p in patterns if fits(p, u))
    assert sorted((r.url, r.r_id) for r in joins.match_rules(pages, rules).collect()) == want
    assert ("https://www.a.com/[abc", "https://www.a.com/[abc") not in want


def test_first_children_are_chosen_before_they_are_gathered(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    child = spark.createDataFrame([("a", i % 5, i) for i in range(20)], "fk string, at long, n long")
    got = {r.id: [(c.at, c.n) for c in r.kids] for r in joins.nest(parent, child, "id", "fk", "at", "kids", most=6, tie="n").collect()}
    assert got == {"a": [(0, 0), (0, 5), (0, 10), (0, 15), (1, 1), (1, 6)], "b": []}


def test_cells_find_most_neighbours(spark, sf_dir):
    import numpy as np

    from tidemark.operators import vectors

    rng = np.random.default_rng(2)
    tight = rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)] + 0.1 * rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(tight)]
    clustered = spark.createDataFrame([*rows, (1500, None), (1501, [1.0]), (1502, [0.0] * 16)], "vec_id long, embedding array<double>")
    spread = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for df, most in ((clustered, 4), (spread, 16)):
        whole = df.where(F.size("embedding") > 1)
        cells = vectors.fit_cells(whole, k=5)
        assert cells.probes <= most
        asked = whole.where("vec_id % 10 = 0 and vec_id < 1500")
        found = {(r["query"], r.vec_id) for r in vectors.near_in_cells(vectors.in_cells(df, cells), asked, cells, 5).collect()}
        want = {(r["query"], r.vec_id) for r in vectors.neighbours(whole, asked, 5).collect()}
        assert len(found & want) >= 0.9 * len(want)


def test_many_wild_rules_meet_pages_by_a_piece(spark):
    """More wild patterns than are broadcast: the same pairs, and no nested loop but for patterns without a piece."""
    import random

    rng = random.Random(6)
    pages = spark.createDataFrame([(i, f"https://{rng.choice('abc')}{i % 7}.site.org/{rng.choice(['en', 'de'])}/{i % 50}") for i in range(300)] + [(900, None)], "page_id long, url string")
    made = [f"http*//{c}?.site*{x}/{n}{e}" for c in "abz[" for x in ("en", "de", "xx") for n in (1, 22, 333) for e in ("", "*", "[0-9]", "[^0-9]*")] + ["*", "h*g/??/1", "[a-h]ttps*/en/4?", "*[", "*.site.org/de/7[", ""]
    rules = spark.createDataFrame([(str(i), p, "", True) for i, p in enumerate(made)], "id string, url_pattern string, page_id string, enabled boolean")
    want = sorted((r.page_id, r.r_id) for r in joins.match_rules(pages, rules).collect())
    got = joins.match_rules(pages, rules, most_broadcast=10)
    assert sorted((r.page_id, r.r_id) for r in got.collect()) == want and len({x for _, x in want}) >= 20
    long = joins.match_rules(pages, rules.where("length(url_pattern) > 12"), most_broadcast=10)
    assert "NestedLoop" not in long._jdf.queryExecution().executedPlan().toString()


def test_neighbours_among_ties_and_vectors_without_length(spark):
    from tidemark.operators import vectors

    rows = [(i, [float(i % 3), 1.0] if i % 5 else [0.0, 0.0]) for i in range(40)] + [(99, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cos = lambda a, b: 0.0 if not (np.linalg.norm(a) and np.linalg.norm(b)) else float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = {i: [j for _, j in sorted((-round(cos(a, b), 12), j) for j, b in rows[:-1] if j != i)[:4]] for i, a in rows[:4]}
    got: dict = {}
    for r in vectors.neighbours(v, v.where("vec_id < 4"), 4, block=2).withColumn("score", F.round("score", 12)).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append((r.vec_id, r.score))
    assert {i: [(s) for _, s in x] for i, x in got.items()} == {i: [round(cos(rows[i][1], rows[j][1]), 12) for j in js] for i, js in want.items()}
    plain = vectors._batches(v, "vec_id", "embedding")
    assert dict(plain.dtypes) == {"ids": "binary", "vs": "binary"}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{8 << 20}b"


def test_rules_of_one_pattern_are_spread_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(joins, "SIDE", 8)
    pages = spark.createDataFrame([(i, f"https://a.org/en/{i % 3}") for i in range(60)], "page_id long, url string")
    rules = spark.createDataFrame([(str(i), "http*/en/1", "", True) for i in range(200)], "id string, url_pattern string, page_id string, enabled boolean")
    got = joins.match_rules(pages, rules, most_broadcast=10).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.page_id, r.r_id) for r in got) == sorted((i, str(j)) for i in range(1, 60, 3) for j in range(200))
    assert max(sum(r.part == p for r in got) for p in {r.part for r in got}) < len(got) / 5


def test_texts_are_split_once_a_reading(spark):
    """Neither filters nor generators repeat the splitting of texts: one for the counts, one for the ranks."""
    docs = spark.createDataFrame([(1, "the lad of the of the"), (1, "of the"), (2, "and of"), (3, None)], "id long, text string")
    split = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("translate(")
    query = '("of the" OR lad*) NOT and'
    index = search.index(docs, "id", ("text",))
    assert split(search.bm25(docs, query, "id", ("text",), limit=None)) == split(search.bm25_index(index, query, "id", ("text",), limit=None)) == 2
    assert split(index) == split(search.postings(docs, "id", "text")) == 1
    assert sorted((r.doc, r.length) for r in index.where("bucket = -1").collect()) == [(1, 2), (1, 6), (2, 2), (3, 0)]
    assert search.bm25(docs.where("id > 1 OR length(text) > 10"), '"of the"', "id", ("text",)).count() == 1
