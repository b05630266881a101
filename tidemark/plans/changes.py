"""Queries of changes of state, orders, look-ups and set operations, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks, rules, text, urls
from ..operators import aggregates as agg
from ..operators import joins, state, vectors
from ..streaming import mutations


def register(query, c) -> None:
    """c: the catalog, for its views."""
    now, table, users, profiles = c.NOW, c.table, c.users, c.profiles
    U, P, R = c.USERS_SQL, c.PROFILES_SQL, c.RECORDS_SQL
    third = lambda n=0: F.col("id").cast("int") % 3 == n
    T = "CAST(id AS INTEGER) % 3"

    # -- sources

    @query(f"WITH {U} SELECT id, CASE WHEN {T} = 0 THEN 'h' || id ELSE '' END AS last_hash, CASE WHEN {T} = 0 THEN 'ok' ELSE last_status END AS last_status, CASE WHEN {T} = 0 THEN 0 ELSE fail_count END AS fail_count, CASE WHEN {T} = 0 THEN {now} ELSE last_fetched_at END AS last_fetched_at FROM users")
    def record_success(spark, d):
        return state.fetch_success(users(spark, d), third(), F.concat(F.lit("h"), "id"), now).select("id", "last_hash", "last_status", "fail_count", "last_fetched_at")

    @query(f"WITH {U} SELECT id, CASE WHEN {T} = 1 THEN 'unchanged' ELSE last_status END AS last_status, CASE WHEN {T} = 1 THEN 0 ELSE fail_count END AS fail_count, CASE WHEN {T} = 1 THEN {now} ELSE last_fetched_at END AS last_fetched_at FROM users")
    def record_unchanged(spark, d):
        return state.fetch_unchanged(users(spark, d), third(1), now).select("id", "last_status", "fail_count", "last_fetched_at")

    @query(f"WITH {U} SELECT id, CASE WHEN {T} = 2 THEN 'error' ELSE last_status END AS last_status, CASE WHEN {T} = 2 THEN 'http ' || id WHEN fail_count > 0 THEN 'http 503' ELSE '' END AS last_error, CAST(fail_count + CASE WHEN {T} = 2 THEN 1 ELSE 0 END AS INTEGER) AS fail_count FROM users")
    def record_error(spark, d):
        return state.fetch_error(users(spark, d), third(2), F.concat(F.lit("http "), "id"), now).select("id", "last_status", "last_error", "fail_count")

    @query(f"WITH {U} SELECT id, CASE WHEN {T} = 0 THEN 'https://new/' || id ELSE 'https://u' || id || '.example.com' END AS url, CASE WHEN {T} = 0 THEN 'pending' ELSE last_status END AS last_status, CASE WHEN {T} = 0 THEN 0 ELSE fail_count END AS fail_count FROM users")
    def follow_redirects(spark, d):
        return state.move_url(users(spark, d), third(), F.concat(F.lit("https://new/"), "id"), now).select("id", "url", "last_status", "fail_count")

    @query(f"WITH {U} SELECT id, CASE WHEN fail_count > 1 THEN 'broken' ELSE last_status END AS last_status, CASE WHEN fail_count > 1 THEN {now} ELSE 0 END AS updated_at FROM users")
    def mark_broken(spark, d):
        return state.set_status(users(spark, d), F.col("fail_count") > 1, "broken", now).select("id", "last_status", "updated_at")

    @query(f"""WITH {U} SELECT id, CASE WHEN {T} = 1 THEN 'renamed ' || id ELSE 'user ' || id END AS name, CASE WHEN {T} = 1 THEN 60000 ELSE fetch_interval END AS fetch_interval, CASE WHEN {T} = 1 THEN false ELSE enabled END AS enabled, CASE WHEN {T} = 1 THEN '{{"a":1}}' ELSE '{{}}' END AS config_json FROM users""")
    def update_sources(spark, d):
        u = state.update(users(spark, d), third(1), name=F.concat(F.lit("renamed "), "id"), fetch_interval=F.lit(60000), enabled=F.lit(False), config_json=F.lit('{"a":1}'), updated_at=F.lit(now))
        return u.select("id", "name", "fetch_interval", "enabled", "config_json")

    @query(f"""WITH {U} SELECT id, CASE WHEN {T} = 0 THEN 'n' || id ELSE 'user ' || id END AS name, CASE WHEN {T} = 1 THEN 'https://m' || id || '.org/a' ELSE 'https://u' || id || '.example.com' END AS url, 'web' AS source_type, CASE WHEN {T} = 0 THEN 120000 ELSE fetch_interval END AS fetch_interval,
        CASE WHEN {T} = 2 THEN enabled ELSE {T} = 1 END AS enabled, CASE WHEN {T} = 2 THEN '{{}}' WHEN {T} = 1 THEN '{{"k":2}}' ELSE '' END AS config_json FROM users""")
    def merge_sources(spark, d):
        u = users(spark, d)
        even, odd = third(), third(1)
        changes = u.where(even | odd).select("id", F.when(even, F.concat(F.lit("n"), "id")).otherwise("").alias("name"), F.when(odd, F.concat(F.lit("HTTPS://M"), "id", F.lit(".org/a/#top"))).otherwise("").alias("url"), F.lit("").alias("source_type"), F.when(even, 120000).otherwise(0).alias("fetch_interval"), odd.alias("enabled"), F.when(odd, '{"k":2}').otherwise("").alias("config_json"))
        return state.merge_source(u, changes, now).select("id", "name", "url", "source_type", "fetch_interval", "enabled", "config_json")

    def incoming(spark, d):
        k = F.col("c_custkey")
        return table(spark, d, "customer").select(k.cast("string").alias("id"), F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("name"), F.concat(F.when(k % 2 == 0, "HTTPS://U").otherwise("https://u"), k % 900, F.lit(".Example.com/#f")).alias("url"), F.when(k % 13 == 0, "odd").otherwise("").alias("source_type"), F.when(k % 17 == 0, 5).otherwise(0).cast("long").alias("fetch_interval"), F.lit("").alias("config_json"), F.lit(True).alias("enabled"), F.lit(0).alias("fail_count"), k.cast("long").alias("created_at"))

    def added(spark, d):
        u = users(spark, d)
        new = incoming(spark, d)
        new = new.select(*(F.col(n) if n in new.columns else F.lit(None).cast(t).alias(n) for n, t in u.dtypes))
        return state.add_sources(u, new, now, most=2500)

    ADDED = f"""{U}, n AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, 'https://u' || (c_custkey % 900) || '.example.com' AS url,
            list_filter([CASE WHEN c_custkey % 11 = 0 THEN 'name required' END, CASE WHEN c_custkey % 13 = 0 THEN 'unknown type' END, CASE WHEN c_custkey % 17 = 0 THEN 'interval out of range' END], lambda x: x IS NOT NULL) AS e FROM customer),
        j AS (SELECT n.*, row_number() OVER (PARTITION BY n.url ORDER BY k, n.id) AS turn, u.id IS NOT NULL AS known FROM n LEFT JOIN users u ON 'https://u' || u.id || '.example.com' = n.url),
        g AS (SELECT *, len(e) = 0 AND NOT known AND turn = 1 AS good FROM j), q AS (SELECT *, CASE WHEN good THEN row_number() OVER (PARTITION BY good ORDER BY k, id) END AS place FROM g),
        s AS (SELECT *, good AND place <= greatest(0, 2500 - (SELECT count(*) FROM users)) AS taken FROM q)"""

    @query(f"WITH {ADDED} SELECT url, count(*) AS sources FROM (SELECT 'https://u' || id || '.example.com' AS url FROM users UNION ALL SELECT url FROM s WHERE taken) GROUP BY url")
    def add_sources(spark, d):
        return added(spark, d)[0].groupBy("url").agg(F.count("*").alias("sources"))

    @query(f"WITH {ADDED} SELECT id, CASE WHEN len(e) > 0 THEN array_to_string(e, ',') WHEN good THEN 'quota' ELSE 'duplicate' END AS reasons FROM s WHERE NOT taken")
    def reject_sources(spark, d):
        return added(spark, d)[1].select("id", F.array_join("errors", ",").alias("reasons"))

    @query(f"WITH {U}, l AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id FROM events) SELECT count(*) AS sources, (SELECT count(*) FROM l WHERE CAST(source_id AS INTEGER) % 7 <> 0) AS log_rows FROM users WHERE CAST(id AS INTEGER) % 7 <> 0")
    def delete_sources(spark, d):
        log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source_id"), "event_id")
        left, kids = state.delete(users(spark, d), F.col("id").cast("int") % 7 == 0, {"log": (log, "source_id")})
        return left.agg(F.count("*").alias("sources")).join(kids["log"].agg(F.count("*").alias("log_rows")), how="cross")  # one row each

    @query(f"WITH {U} SELECT e.event_id, u.id FROM events e JOIN users u ON u.id = CAST(e.user_id AS VARCHAR) WHERE NOT u.enabled")
    def sources_by_url(spark, d):
        u = users(spark, d).where(~F.col("enabled")).select("id", "url")
        return table(spark, d, "events").select("event_id", F.concat(F.lit("https://u"), "user_id", F.lit(".example.com")).alias("url")).join(u, "url").select("event_id", "id")

    @query("""WITH s AS (SELECT c_custkey AS k, 'https://h' || (c_custkey % 400) || '.org/p' AS url FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY k % 7, CAST(k AS VARCHAR)) AS n FROM s)
        SELECT CAST(k AS VARCHAR) AS id, n = 1 AS kept, CASE WHEN n = 1 THEN url END AS url FROM r""")
    def migrate_urls(spark, d):
        k = F.col("c_custkey")
        s = table(spark, d, "customer").select(k.cast("string").alias("id"), F.concat(F.when(k % 2 == 0, "https://H").otherwise("https://h"), k % 400, F.when(k % 3 == 0, ".ORG/p/").otherwise(".org/p#x")).alias("url"), (k % 7).cast("long").alias("created_at"))
        kept, gone = state.normalise_urls(s)
        return kept.select("id", F.lit(True).alias("kept"), "url").unionByName(gone.select("id", F.lit(False).alias("kept"), F.lit(None).cast("string").alias("url")))

    agents = ", ".join(f"'{a}'" for a in state.AGENTS)

    @query(f"""WITH {U}, a AS (SELECT [{agents}] AS a), p AS (SELECT id, CAST(id AS INTEGER) % 4 AS t, a FROM users, a), n AS (SELECT id, t, CASE WHEN t <= 1 THEN [] ELSE a[1:t - 1] END AS tried, CASE WHEN t = 0 THEN 'x' ELSE a[t] END AS used, a FROM p)
        SELECT id, CASE WHEN t = 3 THEN used WHEN t = 0 THEN a[1] ELSE a[t + 1] END AS agent, array_to_string(CASE WHEN t = 3 THEN tried ELSE list_append(tried, used) END, '|') AS tried, 'a.b' AS result_path, '{{"title":"t"}}' AS fields, CASE WHEN t = 3 THEN 'broken' ELSE 'ok' END AS last_status FROM n""")
    def repair_config(spark, d):
        turn = F.col("id").cast("int") % 4
        known = F.array(*map(F.lit, state.AGENTS))
        u = users(spark, d).withColumn("last_status", F.lit("ok"))
        used = F.when(turn == 0, "x").otherwise(F.get(known, turn - 1))
        config = F.to_json(F.struct(F.lit("a.b").alias("result_path"), F.struct(F.lit("t").alias("title")).alias("fields"), used.alias("user_agent"), F.slice(known, F.lit(1), F.greatest(turn - 1, F.lit(0))).alias("tried_uas")))
        u = u.withColumn("config_json", config)
        fixed = state.repair(u, u.select("id", F.lit(403).alias("status"), F.lit("http 403").alias("message")), now)
        j = F.from_json("config_json", "user_agent string, tried_uas array<string>, result_path string")
        return fixed.select("id", j["user_agent"].alias("agent"), F.array_join(j["tried_uas"], "|").alias("tried"), j["result_path"].alias("result_path"), F.get_json_object("config_json", "$.fields").alias("fields"), "last_status")

    @query(f"WITH {U}, s AS (SELECT id, CAST(id AS INTEGER) % 5 AS shard FROM users WHERE last_status IN ('error', 'extract_error', 'broken') OR fail_count > 0) SELECT id, 's' || shard AS shard FROM s")
    def broken_by_shard(spark, d):
        u = users(spark, d)
        parts = [state.broken_sources(u.where(F.col("id").cast("int") % 5 == n)).select("id") for n in range(5)]
        return agg.union_all(parts, "shard", [f"s{n}" for n in range(5)])

    # -- questions

    def questions(spark, d):
        k = F.col("c_custkey")
        return table(spark, d, "customer").select(k.cast("string").alias("id"), F.col("c_name").alias("text"), (k % 5 != 0).alias("enabled"), F.when(k % 4 != 0, F.lit(now) - k * 1_000_000).alias("last_run_at"), F.when(k % 3 == 0, 0).otherwise(k * 900_000).alias("schedule_ms"), F.when(k % 2 == 0, 0).otherwise(k % 50).cast("int").alias("max_results"), F.lit(None).cast("string").alias("channels"), F.lit(0).alias("last_result_count"), (k % 9).alias("total_results"), F.lit(0).cast("long").alias("updated_at"))

    Q = f"q AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_custkey % 5 <> 0 AS enabled, CASE WHEN c_custkey % 4 <> 0 THEN {now} - c_custkey * 1000000 END AS last_run_at, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey * 900000 END AS schedule_ms, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey % 50 END AS max_results FROM customer)"

    @query(f"WITH {Q} SELECT id FROM q WHERE enabled AND (last_run_at IS NULL OR last_run_at + schedule_ms <= {now})")
    def due_questions(spark, d):
        return state.due_questions(questions(spark, d), now).select("id")

    @query(f"WITH {Q} SELECT id, CAST(CASE WHEN schedule_ms = 0 THEN 86400000 ELSE schedule_ms END AS BIGINT) AS schedule_ms, CAST(CASE WHEN max_results = 0 THEN 20 ELSE max_results END AS INTEGER) AS max_results, '[]' AS channels FROM q")
    def question_defaults(spark, d):
        return state.question_defaults(questions(spark, d)).select("id", F.col("schedule_ms").cast("long").alias("schedule_ms"), F.col("max_results").cast("int").alias("max_results"), "channels")

    @query(f"WITH {Q} SELECT id, CASE WHEN k % 3 = 1 THEN {now} ELSE last_run_at END AS last_run_at, CAST(CASE WHEN k % 3 = 1 THEN k % 7 ELSE 0 END AS INTEGER) AS last_result_count, CAST(k % 9 + CASE WHEN k % 3 = 1 THEN k % 7 ELSE 0 END AS BIGINT) AS total_results FROM q")
    def record_question_run(spark, d):
        k = F.col("id").cast("int")
        return state.question_run(questions(spark, d), k % 3 == 1, k % 7, now).select("id", "last_run_at", F.col("last_result_count").cast("int").alias("last_result_count"), F.col("total_results").cast("long").alias("total_results"))

    @query(f"WITH {Q} SELECT id, CAST(CASE WHEN k % 3 = 0 THEN 3600000 ELSE schedule_ms END AS BIGINT) AS schedule_ms, CAST(CASE WHEN k % 3 = 0 THEN 3600000 ELSE schedule_ms END AS BIGINT) AS fetch_interval, CASE WHEN k % 3 = 0 THEN false ELSE enabled END AS enabled FROM q WHERE NOT (k % 3 = 0 AND k % 2 = 0)")
    def update_questions(spark, d):
        """Questions with a new schedule and their sources, after some of both were deleted."""
        q, k = questions(spark, d), F.col("id").cast("int")
        s = q.select("id", F.col("schedule_ms").alias("fetch_interval"), "enabled")
        q = state.update(q, k % 3 == 0, schedule_ms=F.lit(3_600_000), enabled=F.lit(False), updated_at=F.lit(now))
        s = state.update(s, k % 3 == 0, fetch_interval=F.lit(3_600_000), enabled=F.lit(False))
        q, kids = state.delete(q, (k % 3 == 0) & (k % 2 == 0), {"sources": (s, "id")})
        return q.select("id", F.col("schedule_ms").cast("long").alias("schedule_ms")).join(kids["sources"].select("id", F.col("fetch_interval").cast("long").alias("fetch_interval"), "enabled"), "id")

    @query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS text, '["e1","e2"]' AS channels, CAST(86400000 AS BIGINT) AS schedule_ms, 20 AS max_results, true AS follow_links FROM orders""")
    def promote_searches(spark, d):
        log = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("query"), F.array(F.lit("e1"), F.lit("e2")).alias("channels"))
        return state.promote_search(log, now).select("id", "text", "channels", F.col("schedule_ms").cast("long").alias("schedule_ms"), F.col("max_results").cast("int").alias("max_results"), "follow_links")

    @query("""SELECT CAST(c_custkey AS VARCHAR) AS question_id, CAST(i AS INTEGER) AS position, 'e' || ((c_custkey + i) % 7) AS engine_id FROM customer, (SELECT unnest([0, 1, 2]) AS i) WHERE (c_custkey + i) % 7 <> 3""")
    def question_engines(spark, d):
        k = F.col("c_custkey")
        q = table(spark, d, "customer").select(k.cast("string").alias("id"), F.to_json(F.array(*(F.concat(F.lit("e"), (k + i) % 7) for i in range(3)))).alias("channels"))
        e = spark.createDataFrame([(f"e{i}", f"engine {i}", i != 3) for i in range(7)], "id string, name string, enabled boolean")
        return joins.channels_to_engines(q, e).select("question_id", "position", "engine_id")

    @query("""WITH k AS (SELECT DISTINCT 'p' || (l_partkey % 500) AS id FROM lineitem), a AS (SELECT 'p' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT 'p' || s_suppkey AS id, s_name AS name FROM supplier)
        SELECT k.id, coalesce(a.name, b.name) AS name FROM k LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE a.name IS NOT NULL OR b.name IS NOT NULL""")
    def engine_chain(spark, d):
        keys = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 500).alias("id")).distinct()
        first = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3 != 0).alias("enabled"))
        second = table(spark, d, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(True).alias("enabled"))
        return joins.lookup_chain(keys, first, second).select("id", "name")

    # -- rules, content, folders, pages, prices

    def rule_rows(spark, d):
        k = F.col("p_partkey")
        return table(spark, d, "part").select(k.cast("string").alias("id"), F.col("p_name").alias("name"), (k % 40).cast("string").alias("folder_id"), (k % 4 != 0).alias("enabled"), (k % 10).cast("int").alias("priority"), F.lit(1).alias("version"), F.lit(None).cast("long").alias("last_success"), (k % 3).cast("int").alias("fail_count"), k.cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))

    @query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN {now} END AS last_success, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN p_partkey % 3 + 1 ELSE p_partkey % 3 END AS INTEGER) AS fail_count FROM part")
    def rule_outcomes(spark, d):
        k = F.col("id").cast("int")
        return state.rule_failure(state.rule_success(rule_rows(spark, d), k % 5 == 0, now), k % 5 == 1).select("id", "last_success", "fail_count")

    @query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 6 = 0 THEN 'r' || p_partkey ELSE p_name END AS name, CAST(CASE WHEN p_partkey % 6 = 0 THEN 99 ELSE p_partkey % 10 END AS INTEGER) AS priority, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN p_partkey % 6 = 0 THEN {now} ELSE 0 END AS updated_at FROM part WHERE p_partkey % 11 <> 0")
    def update_rules(spark, d):
        r = rule_rows(spark, d)
        changes = r.where(F.col("id").cast("int") % 6 == 0).select("id", F.concat(F.lit("r"), "id").alias("name"), F.lit(99).alias("priority"))
        left, _ = state.delete(state.rule_update(r, changes, now), F.col("id").cast("int") % 11 == 0)
        return left.select("id", "name", "priority", "version", "updated_at")

    @query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 40 >= 10 THEN CAST(p_partkey % 40 AS VARCHAR) END AS folder_id FROM part")
    def delete_folders(spark, d):
        folders = spark.range(40).select(F.col("id").cast("string").alias("id"))
        return state.detach(rule_rows(spark, d), "folder_id", folders.where(F.col("id").cast("int") < 10)).select("id", "folder_id")

    @query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id FROM documents WHERE source <> 'src3' AND NOT coalesce(CASE WHEN doc_id % 4 <> 0 THEN {now} + (doc_id % 200 - 100) * 1000 END < {now}, false)")
    def expire_content(spark, d):
        c_ = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 4 != 0, F.lit(now) + (F.col("doc_id") % 200 - 100) * 1000).alias("expires_at"))
        left, _ = state.delete(c_, F.col("source") == "src3", key="doc_id")
        return left.where(~state.expired(left, now)).select(F.col("doc_id").cast("long").alias("doc_id"))

    @query("SELECT CAST(page_id AS VARCHAR) AS page_id, CASE WHEN page_id % 2 = 0 THEN 'official' ELSE 'old' END AS trust_level, CAST(CASE WHEN page_id % 2 = 0 AND page_id % 6 = 0 THEN 5 WHEN page_id % 2 = 0 THEN 7 ELSE 5 END AS BIGINT) AS created_at FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0")
    def upsert_pages(spark, d):
        p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("page_url"), F.lit("").alias("dom_profile"), F.lit(now).alias("last_seen"))
        k = F.col("page_id").cast("int")
        stored = p.where(k % 3 == 0).select("page_id", "page_url", F.lit("old").alias("trust_level"), "dom_profile", "last_seen", F.lit(5).cast("long").alias("created_at"))
        new = p.where(k % 2 == 0).select("page_id", "page_url", F.lit("official").alias("trust_level"), "dom_profile", "last_seen", F.lit(7).cast("long").alias("created_at"))
        return mutations.upsert_pages(stored, new).select("page_id", "trust_level", "created_at")

    @query(f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status, CASE WHEN event_type = 'error' THEN 'bad' ELSE '' END AS error, CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS extracted_count, {now} AS completed_at FROM events")
    def complete_ingest(spark, d):
        log = table(spark, d, "events").select("event_id", "event_type", "user_id", F.lit("pending").alias("status"), F.lit("").alias("error"), F.lit(0).cast("long").alias("extracted_count"), F.lit(None).cast("long").alias("completed_at"))
        bad = F.col("event_type") == "error"
        done = state.update(log, ~bad, status=F.lit("done"), extracted_count=F.col("user_id"), completed_at=F.lit(now))
        return state.update(done, bad, status=F.lit("error"), error=F.lit("bad"), completed_at=F.lit(now)).select("event_id", "status", "error", "extracted_count", "completed_at")

    @query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN 1.5 ELSE p_retailprice END AS cost_per_unit FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 9 <> 0")
    def active_prices(spark, d):
        p = c.pricing(spark, d)
        new = p.where(F.col("id").cast("int") % 5 == 0).withColumn("cost_per_unit", F.lit(1.5))
        left, _ = state.delete(state.upsert(p, new, "id"), F.col("id").cast("int") % 9 == 0)
        return left.where("status = 'active'").select("id", "cost_per_unit")

    # -- profiles and corrections

    @query(f"WITH {P}, n AS (SELECT domain, max(CAST(id AS INTEGER)) AS m FROM profiles GROUP BY domain) SELECT CAST(min(s_suppkey) AS VARCHAR) AS id, n_name AS url_pattern, CAST(m * 2 AS BIGINT) AS total_uses FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN n ON n.domain = n_name GROUP BY n_name, m")
    def publish_profiles(spark, d):
        p = profiles(spark, d)
        k = F.col("id").cast("int")
        stored = p.groupBy(F.col("domain").alias("url_pattern")).agg(F.min(k).cast("string").alias("id"), F.lit(0).cast("long").alias("total_uses")).select("id", "url_pattern", "total_uses")
        new = p.groupBy(F.col("domain").alias("url_pattern")).agg(F.max(k).cast("string").alias("id"), (F.max(k) * 2).cast("long").alias("total_uses")).select("id", "url_pattern", "total_uses")
        return state.publish_profiles(stored, new)

    @query(f"""WITH {P} SELECT id, CAST(total_uses + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS total_uses, round(CASE WHEN k % 4 = 0 THEN least(1.0, success_rate * 0.95 + 0.05) WHEN k % 4 IN (1, 2) THEN greatest(0.0, success_rate * 0.95) ELSE success_rate END, 9) AS success_rate,
        CAST(total_repairs + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS total_repairs FROM profiles""")
    def profile_outcomes(spark, d):
        k = F.col("k") % 4
        p = state.use_profile(profiles(spark, d), F.col("k") % 2 == 0)
        p = state.report_failure(state.profile_failure(state.profile_success(p, k == 0), k == 1), k == 2)
        return p.select("id", F.col("total_uses").cast("long").alias("total_uses"), F.round("success_rate", 9).alias("success_rate"), F.col("total_repairs").cast("long").alias("total_repairs"))

    @query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b' ELSE 'a,b,c' END AS contributors FROM supplier")
    def add_contributors(spark, d):
        s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("contributors"))
        out = state.add_contributor(s, F.lit(True), F.when(third(), "b").otherwise("c"))
        return out.select("id", F.array_join("contributors", ",").alias("contributors"))

    def corrections(spark, d):
        o = table(spark, d, "orders")
        return o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 100).cast("string").alias("profile_id"), F.col("o_custkey").cast("string").alias("instance_id"), F.col("o_orderkey").cast("string").alias("new_extractors"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", -1).otherwise(0).alias("validated"), F.col("o_orderkey").cast("long").alias("created_at"))

    @query("""WITH h AS (SELECT o_custkey AS c, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY o_custkey)
        SELECT CAST(c_custkey AS VARCHAR) AS instance_id, CASE WHEN coalesce(a >= 3 AND b / nullif(a + b, 0) < 0.2, false) THEN 1 ELSE 0 END AS validated FROM customer LEFT JOIN h ON c = c_custkey""")
    def submit_corrections(spark, d):
        stored = corrections(spark, d)
        new = table(spark, d, "customer").select(F.concat(F.lit("new"), "c_custkey").alias("id"), F.lit("1").alias("profile_id"), F.col("c_custkey").cast("string").alias("instance_id"), F.lit("{}").alias("new_extractors"), F.lit(0).alias("validated"), F.lit(now).alias("created_at"))
        return state.submit_corrections(stored, new).where("id LIKE 'new%'").select("instance_id", "validated")

    DECIDED = "o AS (SELECT o_orderkey AS k, o_custkey % 100 AS p, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS v FROM orders), x AS (SELECT k, p, v, CASE WHEN v = 0 AND k % 2 = 0 THEN 1 WHEN v = 0 AND k % 2 = 1 AND k % 3 = 0 THEN -1 ELSE v END AS n FROM o)"

    def decided(spark, d):
        co = corrections(spark, d)
        k = F.col("id").cast("long")
        pr = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("extractors"), F.lit(0).cast("long").alias("total_repairs"))
        return state.decide(co, pr, co.where(k % 2 == 0).select("id"), co.where((k % 2 == 1) & (k % 3 == 0)).select("id"))

    @query(f"WITH {DECIDED} SELECT CAST(k AS VARCHAR) AS id, CAST(n AS INTEGER) AS validated FROM x")
    def decide_corrections(spark, d):
        return decided(spark, d)[0].select("id", "validated")

    @query(f"WITH {DECIDED}, t AS (SELECT p, count(*) AS n, max(k) AS m FROM x WHERE v = 0 AND n = 1 GROUP BY p) SELECT CAST(i AS VARCHAR) AS id, coalesce(CAST(m AS VARCHAR), 'old') AS extractors, CAST(coalesce(n, 0) AS BIGINT) AS total_repairs FROM (SELECT unnest(generate_series(0, 99)) AS i) LEFT JOIN t ON p = i")
    def repaired_profiles(spark, d):
        return decided(spark, d)[1].select("id", "extractors", "total_repairs")

    @query("SELECT CAST(o_custkey % 100 AS VARCHAR) AS profile_id, count(*) AS pending, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
    def pending_corrections(spark, d):
        return corrections(spark, d).where("validated = 0").groupBy("profile_id").agg(F.count("*").alias("pending"), F.min("created_at").alias("first"))

    # -- orders and pages of rows

    @query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey % 10 AS INTEGER) AS priority FROM part WHERE p_partkey % 4 <> 0 ORDER BY p_partkey % 10 DESC, p_partkey LIMIT 50")
    def rules_by_priority(spark, d):
        return agg.page(rule_rows(spark, d).where("enabled"), F.desc("priority"), "created_at", limit=50).select("id", "priority")

    @query(f"WITH {P} SELECT id, domain FROM profiles WHERE domain IN (SELECT n_name FROM nation WHERE n_regionkey = 1) ORDER BY success_rate DESC, total_uses DESC, id LIMIT 30")
    def profiles_by_rate(spark, d):
        region = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("domain"))
        return agg.page(profiles(spark, d).join(region, "domain"), F.desc("success_rate"), F.desc("total_uses"), "id", limit=30).select("id", "domain")

    @query("SELECT event_id, user_id FROM events WHERE event_type = 'search' OR event_type = 'view' ORDER BY epoch_us(ts) // 1000 DESC, event_id LIMIT 25 OFFSET 25")
    def recent_log(spark, d):
        e = table(spark, d, "events").where(F.col("event_type").isin("search", "view")).withColumn("at", c.millis("ts"))
        return agg.page(e, F.desc("at"), "event_id", limit=25, offset=25).select("event_id", "user_id")

    @query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 10")
    def extractions_by_source(spark, d):
        return agg.newest(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", limit=10).select("doc_id", "place")

    @query("SELECT question_id, url FROM (SELECT CAST(o_custkey AS VARCHAR) AS question_id, 'u' || (o_orderkey % 50) AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS n FROM orders) WHERE n <= 5")
    def cap_results(spark, d):
        from ..operators import handlers

        o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("question_id"), (F.col("o_orderkey") % 3).alias("engine_position"), F.col("o_orderkey").alias("position"), F.lit("t").alias("title"), F.lit("x").alias("text"), F.concat(F.lit("u"), F.col("o_orderkey") % 50).alias("url"))
        q = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit(5).alias("max_results"))
        return handlers.results(o, q).select(F.col("source_id").alias("question_id"), "url")

    # -- sets of passes and shards

    @query("WITH r AS (SELECT l_partkey AS k, l_linenumber AS pass, l_orderkey AS position FROM lineitem) SELECT k, min((pass, position))[1] AS pass, min((pass, position))[2] AS position FROM r GROUP BY k")
    def first_of_passes(spark, d):
        r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("pass"), F.col("l_orderkey").alias("position"))
        return agg.first_of_passes(r, "k", ("pass", "position"))

    # -- streams over tables

    @query(f"""WITH {R}, l AS (SELECT page_id, ts_ms, false AS nav FROM r WHERE op <> 'remove' UNION ALL SELECT page_id, ts_ms, true FROM r WHERE op = 'remove'),
        w AS (SELECT *, lead(ts_ms) OVER (PARTITION BY page_id ORDER BY ts_ms, nav DESC) AS nx, sum(CAST(nav AS INTEGER)) OVER (PARTITION BY page_id ORDER BY ts_ms, nav DESC ROWS UNBOUNDED PRECEDING) AS leg FROM l)
        SELECT page_id, min(ts_ms) AS navigated, min(CASE WHEN nx IS NULL OR nx - ts_ms >= 1800000 THEN ts_ms + 1800000 END) AS settled FROM w WHERE leg > 0 GROUP BY page_id, leg""")
    def settled_pages(spark, d):
        r = c.records(spark, d)
        return mutations.settled(r.where("op <> 'remove'"), r.where("op = 'remove'"), quiet_ms=1_800_000).select("page_id", "navigated", "settled")

    @query(f"WITH {R} SELECT page_id, n, CAST(sum(CASE WHEN op = 'remove' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ts_ms, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM r")
    def reset_epochs(spark, d):
        r = c.records(spark, d).withColumn("op", F.when(F.col("op") == "remove", "doc_reset").otherwise(F.col("op")))
        return mutations.split_at_resets(r).select("page_id", "n", "epoch")

    @query(f"SELECT page_id FROM pages WHERE page_id % 5 <> 0 AND (page_id % 3 = 0 OR {now} - page_id * 100000 + CASE WHEN page_id % 2 = 0 THEN page_id * 50000 ELSE 14400000 END <= {now})")
    def due_snapshots(spark, d):
        k = F.col("page_id")
        p = table(spark, d, "pages").select("page_id", F.when(k % 5 != 0, "active").otherwise("off").alias("status"), F.when(k % 2 == 0, k * 50_000).otherwise(0).alias("snapshot_interval_ms"), F.when(k % 3 != 0, F.lit(now) - k * 100_000).alias("last_snapshot_at"))
        return mutations.snapshot_times(p, now).select("page_id")

    def batches(spark, d):
        r = c.records(spark, d).groupBy("page_id").agg(F.collect_set(F.struct("op")).alias("records"), F.max("ts_ms").alias("timestamp"))
        return r.withColumn("id", F.concat(F.lit("b"), "page_id")).withColumn("page_url", F.concat(F.lit("https://p/"), "page_id"))

    @query(f"WITH {R} SELECT page_id, CASE WHEN bool_or(op IN ('insert', 'remove')) THEN 'significant' ELSE 'minor' END AS kind, 'done' AS status FROM r GROUP BY page_id")
    def batch_log(spark, d):
        return mutations.consume_batches(batches(spark, d), now)[0].select("page_id", "kind", "status")

    @query(f"""WITH {R}, z AS (SELECT page_id, xpath AS selector, count(*) AS mutations, count(*) / 36000.0 AS rate FROM r GROUP BY page_id, xpath)
        SELECT page_id, selector, mutations, CASE WHEN rate > 0.0015 THEN 'dynamic' ELSE 'mixed' END AS zone FROM z""")
    def mutation_zones(spark, d):
        z = agg.mutation_zones(c.records(spark, d).select("page_id", F.col("xpath").alias("selector")), 36_000.0, limit=0.0015)
        return z.select("page_id", "selector", "mutations", "zone")

    @query(f"""WITH {R}, k AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'cdp' ELSE 'js' END AS source FROM r),
        w AS (SELECT *, max(CASE WHEN source = 'js' THEN ts_ms END) OVER (PARTITION BY page_id, op ORDER BY ts_ms, CASE WHEN source = 'js' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM k)
        SELECT page_id, source, count(*) AS kept FROM w WHERE source <> 'cdp' OR l IS NULL OR ts_ms - l > 3600000 GROUP BY page_id, source""")
    def echo_windows(spark, d):
        r = joins.drop_echoes(c.records(spark, d), ("page_id", "op"), "ts_ms", "source", "cdp", "js", within=3_600_000)
        return r.groupBy("page_id", "source").agg(F.count("*").alias("kept"))

    @query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0 WHEN page_id % 4 IN (1, 2) THEN 1 ELSE 3 END AS level FROM pages")
    def stealth_levels(spark, d):
        k = F.col("page_id") % 4
        return table(spark, d, "pages").select("page_id", mutations.stealth_level(F.when(k == 3, "3").otherwise("auto"), F.when(k == 0, True).when(k == 1, False)).alias("level"))

    # -- functions

    @query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\n[\t\n\f\r ]*\n'), lambda x: trim(x, E' \t\n\r\f\v') <> '')) AS BIGINT) AS paragraphs, CAST(len(list_filter(string_split(text, E'\n\n'), lambda x: trim(x, E' \t\n\r\f\v') <> '')) AS BIGINT) AS blocks FROM documents")
    def paragraph_counts(spark, d):
        return table(spark, d, "documents").select("doc_id", F.size(text.paragraphs("text")).cast("long").alias("paragraphs"), F.size(text.blocks("text")).cast("long").alias("blocks"))

    @query("SELECT event_id, sha256(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'g' || event_id END || CASE WHEN event_id % 3 = 0 THEN 'l' || event_id ELSE '' END) AS feed_key, CASE WHEN event_id % 2 = 0 THEN 'given' ELSE sha256('u' || event_id || '|t') END AS item_key, strftime(make_timestamp(event_id * 100000000), '%Y-%m-%d') AS day, CAST(CAST(round_even(CAST(event_id % 1000 AS DOUBLE) / 1000 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM events")
    def keys_and_formats(spark, d):
        k = F.col("event_id")
        return table(spark, d, "events").select("event_id", text.feed_key(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("g"), k)), F.concat(F.lit("l"), k)).alias("feed_key"), text.item_key(F.concat(F.lit("u"), k), F.lit("t"), F.when(k % 2 == 0, "given").otherwise("")).alias("item_key"), text.day(k * 100_000).alias("day"), text.percent((k % 1000) / 1000.0).alias("share"))

    @query("SELECT doc_id, 'https://e/?q=' || replace(source || ' ' || lang, ' ', '+') AS url, 'own' || (doc_id % 7) AS owner, lang AS repo, CASE WHEN doc_id % 2 = 0 THEN 'issues' ELSE '' END AS resource FROM documents")
    def url_templates(spark, d):
        g = urls.github(F.concat(F.lit("https://github.com/own"), F.col("doc_id") % 7, F.lit("/"), "lang", F.when(F.col("doc_id") % 2 == 0, "/issues").otherwise("")))
        return table(spark, d, "documents").withColumn("q", F.concat_ws(" ", "source", "lang")).select("doc_id", urls.template("https://e/?q={query}", "q").alias("url"), g["owner"].alias("owner"), g["repo"].alias("repo"), g["resource"].alias("resource"))

    @query("SELECT doc_id, ((n_chars / 10.0 < 50) AND doc_id % 2 = 0) OR doc_id % 5 = 0 AS needs_ocr, (doc_id % 3 > 0) AND doc_id % 2 = 0 AS visual_gap, CASE doc_id % 5 WHEN 0 THEN 1.3 WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 WHEN 3 THEN 0.8 ELSE 1.0 END::DOUBLE AS trust FROM documents")
    def page_flags(spark, d):
        k = F.col("doc_id")
        images = k % 2 == 0
        level = F.element_at(F.array(*map(F.lit, ("official", "institutional", "community", "unverified", "other"))), (k % 5 + 1).cast("int"))
        return table(spark, d, "documents").select("doc_id", text.needs_ocr(F.col("n_chars") / 10, images, F.when(k % 5 == 0, 0.5).otherwise(0.9)).alias("needs_ocr"), text.has_visual_gap(k % 3, images).alias("visual_gap"), rules.trust_multiplier(level).alias("trust"))

    @query("""SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'name required' END, CASE WHEN c_custkey % 3 = 0 THEN 'url required' END, CASE WHEN c_custkey % 5 = 0 THEN 'unknown type' END, CASE WHEN c_custkey % 7 = 0 THEN 'interval out of range' END, CASE WHEN c_custkey % 11 = 0 THEN 'config is not JSON' END, CASE WHEN c_custkey % 13 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN 'path leaves its folder' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer""")
    def source_errors(spark, d):
        k = F.col("c_custkey")
        kind = F.when(k % 5 == 0, "odd").when(k % 13 == 0, "document").otherwise("web")
        e = rules.validate_source(F.when(k % 2 == 0, "").otherwise("n"), F.when(k % 3 == 0, "").when(k % 13 == 0, "a/%2e%2e/b").otherwise("https://x.y"), kind, F.when(k % 7 == 0, 1).otherwise(3_600_000), F.when(k % 11 == 0, "{").otherwise('{"a":1}'))
        return table(spark, d, "customer").select(k.alias("id"), F.array_join(e, ",").alias("errors"))

    @query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS score FROM embeddings""")
    def cosine_with_norms(spark, d):
        v = table(spark, d, "embeddings").withColumn("n", vectors.norm("embedding"))
        return v.select("vec_id", F.round(vectors.cosine("embedding", F.reverse(F.col("embedding")), F.col("n"), F.col("n")), 6).alias("score"))

    @query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INTEGER) AS size, CAST(4 * len(embedding) AS INTEGER) AS bytes FROM embeddings")
    def vector_bytes(spark, d):
        v = table(spark, d, "embeddings").withColumn("b", vectors.to_bytes("embedding")).withColumn("back", vectors.from_bytes("b"))
        return v.select("vec_id", F.round(F.get("back", F.lit(0)).cast("double"), 6).alias("first"), F.size("back").alias("size"), F.octet_length("b").alias("bytes"))

    @query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS t FROM documents), n AS (SELECT doc_id, t, len(t) AS n, greatest(CAST(ceil((len(t) - 512) / 448) AS BIGINT) + 1, 1) AS k FROM w WHERE len(t) > 512),
        c AS (SELECT doc_id, t, n, CASE WHEN n - (k - 1) * 448 < 32 THEN k - 1 ELSE k END AS kept FROM n) SELECT doc_id, CAST(kept AS BIGINT) AS chunks, CAST((kept - 1) * 64 AS BIGINT) AS overlap FROM c""")
    def chunk_overlaps(spark, d):
        k = chunks.chunk_table(table(spark, d, "documents").select("doc_id", "text"))
        return k.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("overlap").alias("overlap")).where("chunks > 1")
