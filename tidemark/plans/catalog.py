"""The registered queries over the test tables, and the DuckDB SQL that gives the same rows.

The tables stand in for those of a content store: events for fetches, searches and mutations, suppliers and parts for profiles
and prices, documents for extracted content, pages for fetched pages.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import aggregates as agg
from ..operators import joins, search, state, vectors
from ..streaming import mutations
from . import changes, more, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: A fixed moment after all events (2024-02-01 UTC), in milliseconds.
NOW = 1_706_745_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


# -- shared views -----------------------------------------------------------------------------------------------------


def users(spark: SparkSession, d: str) -> DataFrame:
    """Sources, one per user: the last event is the last fetch, the run of errors at the end counts failures."""
    e = table(spark, d, "events").select("user_id", "event_id", millis("ts").alias("at"), (F.col("event_type") == "error").alias("bad"))
    last = e.groupBy("user_id").agg(F.max("at").alias("last_at"), F.max(F.when(~F.col("bad"), F.struct("at", "event_id"))).alias("good"), F.max_by("bad", F.struct("at", "event_id")).alias("failing"))
    runs = e.join(last.select("user_id", "good"), "user_id").where(F.col("good").isNull() | (F.struct("at", "event_id") > F.col("good"))).groupBy("user_id").agg(F.count("*").alias("fail_count"))
    s = last.join(runs, "user_id", "left")
    interval = F.lit(3_600_000) * (1 + F.col("user_id") % 400)
    return s.select(
        F.col("user_id").cast("string").alias("id"), F.concat(F.lit("user "), "user_id").alias("name"), F.concat(F.lit("https://u"), "user_id", F.lit(".example.com")).alias("url"), F.lit("web").alias("source_type"), interval.alias("fetch_interval"),
        (F.col("user_id") % 10 != 3).alias("enabled"), F.lit("{}").alias("config_json"), F.when(F.col("user_id") % 17 != 0, F.col("last_at")).alias("last_fetched_at"), F.lit("").alias("last_hash"), F.when(F.col("failing"), "error").otherwise("ok").alias("last_status"),
        F.when(F.col("failing"), "http 503").otherwise("").alias("last_error"), F.coalesce("fail_count", F.lit(0)).cast("int").alias("fail_count"), F.lit(None).cast("long").alias("original_fetch_interval"), F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"),
    )


USERS_SQL = """
    e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ms, event_type = 'error' AS bad FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS n FROM e),
    f AS (SELECT user_id, coalesce(min(n) FILTER (NOT bad), max(n) + 1) - 1 AS fail_count, max(ms) AS last_at FROM r GROUP BY user_id),
    users AS (
        SELECT CAST(user_id AS VARCHAR) AS id, user_id % 10 <> 3 AS enabled, CAST(3600000 * (1 + user_id % 400) AS BIGINT) AS fetch_interval, CASE WHEN user_id % 17 <> 0 THEN last_at END AS last_fetched_at,
            CASE WHEN fail_count > 0 THEN 'error' ELSE 'ok' END AS last_status, CAST(fail_count AS INTEGER) AS fail_count FROM f)
"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("n_name").alias("domain"), F.col("s_suppkey").alias("k"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s_acctbal") + 1000) / 11_000)).alias("success_rate"),
        (F.col("s_suppkey") % 97).alias("total_uses"), (F.col("s_suppkey") % 5).alias("total_repairs"), (F.col("s_suppkey") * 1000).alias("updated_at"),
    )


PROFILES_SQL = """
    profiles AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, n_name AS domain, s_suppkey AS k, least(1.0, greatest(0.0, (s_acctbal + 1000) / 11000)) AS success_rate,
        s_suppkey % 97 AS total_uses, s_suppkey % 5 AS total_repairs, s_suppkey * 1000 AS updated_at FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents cleaned, deduplicated by hash and ranked for a two-term search."""
    docs = table(spark, d, "documents").select("doc_id", text.clean("text").alias("body"), "source", "lang").withColumn("content_hash", text.sha256("body"))
    kept = docs.groupBy("content_hash").agg(F.min(F.struct("doc_id", "body", "source", "lang")).alias("x")).select("x.*")
    return search.bm25(kept, "the tion", "doc_id", ("body",), keep=("source",)).withColumn("rank", F.round("rank", 6))


BM25_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t, source FROM documents),
    s AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (list_contains(t, 'thing')) AS d1, count(*) FILTER (list_contains(t, 'ering')) AS d2 FROM d),
    f AS (SELECT doc_id, source, len(t) AS l, len(list_filter(t, lambda x: x = 'thing')) AS f1, len(list_filter(t, lambda x: x = 'ering')) AS f2 FROM d WHERE list_contains(t, 'thing') AND list_contains(t, 'ering'))
    SELECT doc_id, source, round(-(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / a))), 6) AS rank FROM f, s
"""


# -- full-text search -------------------------------------------------------------------------------------------------


@query(BM25_SQL)
def fts_match_bm25(spark, d):
    return search.bm25(table(spark, d, "documents"), "thing ering", "doc_id", ("text",), limit=None, keep=("source",)).withColumn("rank", F.round("rank", 6))


@query("""
    WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM d GROUP BY term
""")
def fts_vocabulary(spark, d):
    return search.vocabulary(table(spark, d, "documents"), "doc_id", "text")


@query("""
    WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents)
    SELECT doc_id FROM d WHERE (t LIKE '% of the %' OR t LIKE '% lad%') AND NOT t LIKE '% and %'
""")
def fts_boolean_query(spark, d):
    return search.bm25(table(spark, d, "documents"), '("of the" OR lad*) NOT and', "doc_id", ("text",), limit=None).select("doc_id")


@query("""
    WITH d AS (
        SELECT doc_id, CASE quality WHEN 1 THEN 'official' WHEN 0 THEN 'unverified' ELSE 'community' END AS trust, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t
        FROM documents LEFT JOIN labels USING (doc_id)
    ),
    f AS (
        SELECT doc_id, trust, len(t) AS l, len(list_filter(t, lambda x: x = 'the'))::DOUBLE AS f1, len(list_filter(t, lambda x: x = 'of'))::DOUBLE AS f2,
            len(list_filter(t, lambda x: x = 'and'))::DOUBLE AS f3, len(list_filter(t, lambda x: x = 'to'))::DOUBLE AS f4,
            len(list_filter(range(1, len(t) - 2), lambda i: t[i] = 'the' AND t[i + 1] = 'of' AND t[i + 2] = 'and' AND t[i + 3] = 'to'))::DOUBLE AS f5
        FROM d
    ),
    s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3, count(*) FILTER (f4 > 0) AS d4, count(*) FILTER (f5 > 0) AS d5 FROM f),
    w AS (
        SELECT f.*, f5 > 0 AS phrase, f1 > 0 AND f2 > 0 AS half, half AND f3 > 0 AND f4 > 0 AS whole, 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a) AS norm, 2.2::DOUBLE AS k,
            [greatest(ln((n - x + 0.5) / (x + 0.5)), 1e-6) FOR x IN [d1, d2, d3, d4, d5]] AS idf
        FROM f, s
    ),
    r AS (
        SELECT *, idf[1] * f1 * k / (f1 + norm) AS r1, idf[2] * f2 * k / (f2 + norm) AS r2, idf[3] * f3 * k / (f3 + norm) AS r3, idf[4] * f4 * k / (f4 + norm) AS r4, idf[5] * f5 * k / (f5 + norm) AS r5 FROM w
    ),
    passes AS (
        SELECT 1 AS pass, doc_id, trust, r1 + r2 + r3 + r4 AS rank FROM r WHERE whole
        UNION ALL SELECT 2, doc_id, trust, r5 FROM r WHERE phrase
        UNION ALL SELECT 3, doc_id, trust, r1 + r2 FROM r WHERE half
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY rank DESC, doc_id) AS position FROM passes QUALIFY position <= 20),
    firsts AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pass, position) = 1),
    ordered AS (SELECT *, row_number() OVER (ORDER BY pass, position) AS whole_place, count(*) OVER () AS n FROM firsts),
    scored AS (SELECT *, ((n - whole_place + 1) * CASE trust WHEN 'official' THEN 1.3 WHEN 'community' THEN 1.0 WHEN 'unverified' THEN 0.8 ELSE 1.0 END)::DOUBLE AS score FROM ordered)
    SELECT doc_id, pass, position, score, row_number() OVER (ORDER BY score DESC, whole_place) AS place FROM scored QUALIFY place <= 20
""")
def fts_tiered_search(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("trust", F.when(F.col("quality") == 1, "official").when(F.col("quality") == 0, "unverified").otherwise("community"))
    return search.tiered(docs, "the of and to", "doc_id", ("text",), tier="premium", trust="trust")


@query(BM25_SQL)
def fts_index_bm25(spark, d):
    """The same ranks by an index."""
    docs = table(spark, d, "documents")
    ranked = search.bm25_index(search.index(docs, "doc_id", ("text",)), "thing ering", "doc_id", ("text",), limit=None)
    # each ranked document is one of docs; an inner join's filter would part the readings for counts and ranks
    return ranked.join(docs.select("doc_id", "source"), "doc_id", "left").withColumn("rank", F.round("rank", 6)).select("doc_id", "source", "rank")


@query("""
    WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents)
    SELECT doc_id FROM d WHERE (t LIKE '% of the %' OR t LIKE '% lad%') AND NOT t LIKE '% and %'
""")
def fts_index_boolean(spark, d):
    postings = search.index(table(spark, d, "documents"), "doc_id", ("text",))
    return search.bm25_index(postings, '("of the" OR lad*) NOT and', "doc_id", ("text",), limit=None).select("doc_id")


@query("""
    WITH d AS (SELECT 1), x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'new ' || source ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0),
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS term FROM x WHERE doc_id % 3 = 1 OR doc_id % 7 <> 0) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term
""")
def fts_index_maintained(spark, d):
    """An index of some documents, after a part of them was changed and another deleted."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    postings = search.index(docs.where("doc_id % 3 = 2"), "doc_id", ("text",))
    fresh = docs.where("doc_id % 3 = 1").select("doc_id", F.concat(F.lit("new "), "source").alias("text"))
    now = search.maintain(postings, "doc_id", ("text",), inserted=fresh, deleted=docs.where("doc_id % 7 = 0").select("doc_id"))
    return now.where("bucket >= 0").groupBy("term").agg(F.count_distinct("doc").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


# -- filters, state ---------------------------------------------------------------------------------------------------


@query(f"WITH {USERS_SQL} SELECT id, last_fetched_at, fail_count FROM users WHERE enabled AND fail_count < 10 AND (last_fetched_at IS NULL OR last_fetched_at + fetch_interval <= {NOW})")
def due_sources(spark, d):
    return state.due_sources(users(spark, d), NOW).select("id", "last_fetched_at", "fail_count")


@query(f"WITH {USERS_SQL} SELECT id, fail_count, last_status FROM users WHERE last_status IN ('error', 'extract_error', 'broken') OR fail_count > 0")
def broken_sources(spark, d):
    return state.broken_sources(users(spark, d)).select("id", "fail_count", "last_status")


@query(f"""WITH {USERS_SQL} SELECT id, CASE WHEN fail_count > 0 THEN least(fetch_interval * 2, 86400000) ELSE fetch_interval END AS fetch_interval,
    CASE WHEN fail_count > 0 THEN fetch_interval END AS original_fetch_interval, last_status FROM users""")
def repair_backoff(spark, d):
    u = users(spark, d)
    failures = u.where("fail_count > 0").select("id", F.lit(503).alias("status"), F.col("last_error").alias("message"))
    return state.repair(u, failures, NOW).select("id", "fetch_interval", "original_fetch_interval", "last_status")


@query(f"""WITH {USERS_SQL} SELECT id, CASE WHEN last_status = 'error' THEN 'pending' ELSE last_status END AS last_status, CASE WHEN last_status = 'error' THEN 0 ELSE fail_count END AS fail_count FROM users""")
def reset_failed(spark, d):
    return state.reset(users(spark, d), F.col("last_status") == "error", NOW).select("id", "last_status", "fail_count")


@query(f"""WITH {USERS_SQL}, p AS (SELECT id, fail_count > 0 AS tried, CAST(id AS INTEGER) % 3 <> 0 AS well FROM users)
    SELECT count(*) FILTER (tried) AS probed, count(*) FILTER (tried AND well) AS recovered FROM p""")
def sweep_summary(spark, d):
    u = users(spark, d)
    probes = u.select("id", F.when(F.col("id").cast("int") % 3 != 0, 200).otherwise(503).alias("status_code"))
    return state.sweep(u, probes, NOW)[1]


@query(f"""WITH {USERS_SQL} SELECT id, coalesce(NOT last_fetched_at > {NOW} - 500000000, true) AS stale FROM users WHERE enabled AND fail_count < 10 AND NOT coalesce(last_fetched_at > {NOW} - 500000000, false)""")
def stale_rules(spark, d):
    r = users(spark, d).withColumnRenamed("last_fetched_at", "last_success")
    return state.stale_rules(r, NOW, freshness=500_000_000).select("id", F.lit(True).alias("stale"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
    x AS (SELECT user_id, 0 AS n, CAST(1.0 AS DOUBLE) AS r FROM (SELECT DISTINCT user_id FROM events) UNION ALL
        SELECT x.user_id, e.n, CASE WHEN good THEN least(1.0, r * 0.95 + 0.05) ELSE greatest(0.0, r * 0.95) END FROM x JOIN e ON e.user_id = x.user_id AND e.n = x.n + 1)
    SELECT user_id, CAST(max(n) AS BIGINT) AS events, round(max_by(r, n), 9) AS success_rate FROM x GROUP BY user_id
""")
def ema_success_rate(spark, d):
    e = table(spark, d, "events").withColumn("at", millis("ts"))
    return state.ema_fold(e, "user_id", ("at", "event_id"), F.col("event_type") != "error").withColumn("success_rate", F.round("success_rate", 9))


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS instance_id, count(*) FILTER (o_orderstatus = 'F') AS corrections_accepted, count(*) FILTER (o_orderstatus = 'P') AS corrections_rejected, count(*) FILTER (o_orderstatus = 'O') AS corrections_pending,
        max(epoch_ms(o_orderdate)) AS last_active,
        count(*) FILTER (o_orderstatus = 'F') >= 3 AND coalesce(count(*) FILTER (o_orderstatus = 'P') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'P')), 0) < 0.2, false) AS auto_accept
    FROM orders GROUP BY o_custkey
""")
def instance_reputation(spark, d):
    return reputation(spark, d).drop("domains_covered").withColumn("auto_accept", rules.auto_accept(F.col("corrections_accepted"), F.col("corrections_rejected")))


def reputation(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("instance_id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", -1).otherwise(0).alias("validated"), millis("o_orderdate").alias("created_at"))
    return state.reputation(o)


@query("SELECT CAST(min(doc_id) AS BIGINT) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY text")
def insert_if_new(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.sha256("text").alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n, source, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1) WHERE n = 1 AND (source, h) NOT IN (SELECT source, sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def dedup_anti_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", text.sha256("text").alias("content_hash"))
    return state.insert_new(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source", order=("doc_id",)).select("doc_id")


# -- aggregates and orders --------------------------------------------------------------------------------------------


@query("SELECT event_type AS tier, count(*) AS searches, round(avg(user_id % 3), 9) AS avg_passes, round(avg(user_id), 9) AS avg_results, round(avg(event_id % 1000), 9) AS avg_latency_ms, CAST(sum(user_id) AS BIGINT) AS total_results FROM events GROUP BY event_type")
def search_tier_stats(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("tier"), (F.col("user_id") % 3).alias("passes"), F.col("user_id").alias("results_count"), (F.col("event_id") % 1000).alias("latency_ms"))
    return agg.tier_stats(log).withColumns({c: F.round(c, 9) for c in ("avg_passes", "avg_results", "avg_latency_ms")})


@query(f"""WITH {PROFILES_SQL} SELECT domain, count(*) AS profile_count, round(avg(success_rate), 9) AS avg_success_rate, CAST(sum(total_uses) AS BIGINT) AS total_uses, CAST(sum(total_repairs) AS BIGINT) AS total_repairs, max(updated_at) AS last_updated,
    CASE WHEN avg(success_rate) < 0.5 THEN 'bad' WHEN avg(success_rate) < 0.8 THEN 'warn' ELSE 'good' END AS badge FROM profiles GROUP BY domain""")
def domain_leaderboard(spark, d):
    return agg.domain_leaderboard(profiles(spark, d)).withColumn("badge", rules.success_badge(F.col("avg_success_rate"))).withColumn("avg_success_rate", F.round("avg_success_rate", 9))


@query("""
    WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS instance_id, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY o_custkey)
    SELECT instance_id, a AS corrections_accepted, row_number() OVER (ORDER BY a DESC, b, instance_id) AS rank, CASE WHEN a + b = 0 THEN 'warn' WHEN a / (a + b) >= 0.8 THEN 'good' WHEN a / (a + b) >= 0.5 THEN 'warn' ELSE 'bad' END AS badge
    FROM r ORDER BY rank LIMIT 50
""")
def instance_leaderboard(spark, d):
    top = agg.instance_leaderboard(reputation(spark, d), 50)
    top = agg.ranked(top, F.desc("corrections_accepted"), "corrections_rejected", "instance_id").withColumn("badge", rules.ratio_badge(F.col("corrections_accepted"), F.col("corrections_rejected")))
    return top.select("instance_id", "corrections_accepted", F.col("rank").cast("long").alias("rank"), "badge")


@query("SELECT 'sources' AS what, count(*) AS rows FROM pages UNION ALL SELECT 'extractions', count(*) FROM documents UNION ALL SELECT 'fetch_log', count(*) FROM events")
def space_stats(spark, d):
    return agg.counts({"sources": table(spark, d, "pages"), "extractions": table(spark, d, "documents"), "fetch_log": table(spark, d, "events")})


@query("SELECT n.n_name AS name, CAST(n.n_nationkey AS VARCHAR) AS dossier_id, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS sources, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS extractions FROM nation n WHERE n_nationkey % 5 <> 4")
def shard_overview(spark, d):
    shards = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("dossier_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 4, "active").otherwise("closed").alias("status"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("dossier_id"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("dossier_id"))
    return agg.counts_by_shard(shards, {"sources": s, "extractions": c})


def pricing(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 7 != 0, "active").otherwise("old").alias("status"), (F.col("p_partkey") % 2 == 0).alias("is_dedicated"), F.col("p_retailprice").alias("cost_per_unit"), (F.col("p_size") / 1000).alias("cost_per_sec"))


@query("""(SELECT CAST(p_partkey AS VARCHAR) AS id, p_retailprice AS cost_per_unit, false AS is_dedicated FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 2 = 1 ORDER BY p_retailprice, id LIMIT 1)
    UNION ALL (SELECT CAST(p_partkey AS VARCHAR), p_retailprice, true FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 2 = 0 ORDER BY p_retailprice, CAST(p_partkey AS VARCHAR) LIMIT 1)""")
def cheapest_prices(spark, d):
    p = pricing(spark, d)
    return agg.cheapest(p, False).unionByName(agg.cheapest(p, True)).select("id", "cost_per_unit", "is_dedicated")


@query("""SELECT 100.0::DOUBLE AS backlog_units, round(100.0 * min(p_retailprice) FILTER (p_partkey % 2 = 1), 6) AS serverless_cost,
    round(min_by(p_size / 1000, (p_retailprice, CAST(p_partkey AS VARCHAR))) FILTER (p_partkey % 2 = 0) * 2592000, 6) AS dedicated_cost, 'dedicated' AS decision FROM part WHERE p_partkey % 7 <> 0""")
def cost_decision(spark, d):
    return agg.cost_decision(pricing(spark, d), 100.0).withColumns({c: F.round(c, 6) for c in ("serverless_cost", "dedicated_cost")})


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id) AS place FROM events) WHERE place <= 50")
def fetch_history(spark, d):
    return agg.newest(table(spark, d, "events").withColumn("at", millis("ts")), "user_id", "at", "event_id").select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT source, max_by(doc_id, (n_chars, doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def latest_content(spark, d):
    return agg.latest(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def search_page(spark, d):
    return agg.page(table(spark, d, "documents").select("doc_id", "n_chars"), F.desc("n_chars"), "doc_id", limit=20, offset=40)


@query("SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS pages, max(page_id) AS last_page FROM pages GROUP BY host")
def pages_by_host(spark, d):
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.max("page_id").alias("last_page"))


@query("SELECT user_id, list(event_type ORDER BY (epoch_us(ts) // 1000), event_id)[:5] AS first_types, count(*) AS events FROM events GROUP BY user_id")
def nested_children(spark, d):
    e = table(spark, d, "events").select("user_id", millis("ts").alias("at"), "event_id", "event_type")
    users_ = e.select("user_id").distinct()
    n = joins.nest(users_, e, "user_id", "user_id", "at", "children", most=5, tie="event_id")
    return n.join(e.groupBy("user_id").agg(F.count("*").alias("events")), "user_id").select("user_id", F.transform("children", lambda c: c["event_type"]).alias("first_types"), "events")


# -- text -------------------------------------------------------------------------------------------------------------

_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}]', '', 'g'), '[\t\n\f\r ]+', ' ', 'g'), E' \t\n\r\f\v')"


@query(rf"SELECT doc_id, sha256({_CLEAN}) AS clean_hash, length({_CLEAN}) AS clean_chars FROM documents")
def clean_text(spark, d):
    c = text.clean("text")
    return table(spark, d, "documents").select("doc_id", text.sha256(c).alias("clean_hash"), F.char_length(c).cast("long").alias("clean_chars"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower({_CLEAN}), '[^\p{{L}}\p{{Nd}}\s]', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'))) AS norm_hash FROM documents")
def normalise_for_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sha256(text.normalise_for_hash("text")).alias("norm_hash"))


@query(r"""
    WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS t FROM documents)
    SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(floor((floor(length(text) / 4) + floor(len(t) * 4 / 3)) / 2) AS BIGINT) AS estimate,
        round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(t, lambda x: length(x) BETWEEN 2 AND 15)) / len(t) END, 9) AS wordlike FROM w
""")
def text_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count("text").alias("tokens"), text.estimate_tokens("text").alias("estimate"), F.round(text.wordlike_ratio("text"), 9).alias("wordlike"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\r\t]', '', 'g')) / greatest(length(text), 1), 9) AS printable, CAST(len(regexp_extract_all(text, '(?i)(figure|fig\.?|tableau|table)\s+\d+')) AS BIGINT) AS figures FROM documents")
def printable_and_figures(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.printable_ratio("text"), 9).alias("printable"), F.regexp_count("text", F.lit(text.VISUAL[1])).cast("long").alias("figures"))


@query(r"""
    WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS t FROM documents),
    n AS (SELECT *, len(t) AS n, greatest(CAST(ceil((len(t) - 512) / 448) AS BIGINT) + 1, 1) AS k FROM w WHERE len(t) > 0),
    c AS (SELECT doc_id, t, text, n, k, n - (k - 1) * 448 AS last, CASE WHEN k > 1 AND n - (k - 1) * 448 < 32 THEN k - 1 ELSE k END AS kept FROM n),
    i AS (SELECT *, unnest(generate_series(0, kept - 1)) AS idx FROM c)
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(least(n - idx * 448, 512) + CASE WHEN kept < k AND idx = kept - 1 THEN last ELSE 0 END AS INTEGER) AS tokens, CAST(CASE WHEN idx = 0 THEN 0 ELSE 64 END AS INTEGER) AS overlap,
        sha256(CASE WHEN n <= 512 THEN text ELSE array_to_string(t[idx * 448 + 1 : least(idx * 448 + 512, n)], ' ') || CASE WHEN kept < k AND idx = kept - 1 THEN ' ' || array_to_string(t[(k - 1) * 448 + 1 : n], ' ') ELSE '' END END) AS chunk_hash FROM i
""")
def chunk_windows(spark, d):
    from ..functions import chunks

    c = chunks.chunk_table(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", "idx", "tokens", "overlap", text.sha256("chunk_text").alias("chunk_hash"))


@query(r"""
    WITH u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS v FROM pages), p AS (SELECT page_id, split_part(v, '?', 1) AS path, CASE WHEN contains(v, '?') THEN regexp_replace(v, '^[^?]*\?', '') ELSE '' END AS q FROM u),
    n AS (SELECT page_id, regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url FROM p)
    SELECT min(page_id) AS page_id, url, count(*) AS pages FROM n GROUP BY url
""")
def normalise_urls(spark, d):
    p = table(spark, d, "pages").select("page_id", urls.normalise("url").alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages"))


@query("""
    WITH r(r_id, pattern, priority) AS (VALUES ('r1', 'http://*.example.com/fr/*', 10), ('r2', '*page=2*', 5), ('r3', 'http://[a-m]*', 1), ('r4', 'http://?????.example.com/*', 7))
    SELECT page_id, r_id, CAST(priority AS INTEGER) AS r_priority FROM pages, r WHERE url GLOB pattern
""")
def match_rules(spark, d):
    rows = [("r1", "http://*.example.com/fr/*", 10), ("r2", "*page=2*", 5), ("r3", "http://[a-m]*", 1), ("r4", "http://?????.example.com/*", 7)]
    r = spark.createDataFrame([(i, p, n, "", True) for i, p, n in rows], "id string, url_pattern string, priority int, page_id string, enabled boolean")
    return joins.match_rules(table(spark, d, "pages"), r).select("page_id", "r_id", "r_priority")


@query("""
    WITH r AS (SELECT event_id, 'http*' || (['/en/', '/de/', '/fr/', '?es/'])[event_id % 4 + 1] || CAST(event_id % 1000 AS VARCHAR) || (['', '*', '[/?]*', '?page=[0-9]*'])[event_id // 4 % 4 + 1] AS pattern FROM events)
    SELECT page_id, CAST(event_id AS VARCHAR) AS r_id FROM pages, r WHERE url GLOB pattern
""")
def match_rules_wild(spark, d):
    """As many rules as there are events, with wildcards in their hosts: each meets the pages that have its rarest piece."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    e = F.col("event_id")
    pattern = F.concat(F.lit("http*"), pick(("/en/", "/de/", "/fr/", "?es/"), e % 4), (e % 1000).cast("string"), pick(("", "*", "[/?]*", "?page=[0-9]*"), F.floor(e / 4) % 4))
    r = table(spark, d, "events").select(e.cast("string").alias("id"), pattern.alias("url_pattern"), F.lit(0).alias("priority"), F.lit("").alias("page_id"), F.lit(True).alias("enabled"))
    return joins.match_rules(table(spark, d, "pages").select("page_id", "url"), r, most_broadcast=100).select("page_id", "r_id")


@query("""
    WITH e AS (SELECT event_id, event_type, CASE event_id % 9 WHEN 0 THEN 'http 503' WHEN 1 THEN 'fetch: http 404' WHEN 2 THEN 'status 429 slow down' WHEN 3 THEN 'xml syntax error' WHEN 4 THEN 'dial: timeout' WHEN 5 THEN 'http: 403' WHEN 6 THEN 'status: 301' WHEN 7 THEN 'json unexpected end' ELSE 'odd' END AS m FROM events),
    c AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(m, '(?:http:?|status:?) +([0-9]+)', 1), '') AS INTEGER), 0) AS s FROM e)
    SELECT event_id, s AS status, CASE WHEN s IN (301, 302) THEN 'redirect' WHEN s = 429 THEN 'rate_limit' WHEN s = 403 THEN 'forbidden' WHEN s = 404 THEN 'not_found' WHEN s >= 500 THEN 'temporary' WHEN m LIKE 'xml%' OR m LIKE 'json%' THEN 'parse' WHEN m LIKE '%timeout' THEN 'temporary' ELSE 'unknown' END AS error_class,
        CASE WHEN s IN (301, 302) THEN 'follow_redirect' WHEN s = 429 THEN 'increase_rate' WHEN s = 403 AND event_type = 'view' THEN 'rotate_ua' WHEN s IN (403, 404) THEN 'mark_broken' WHEN s >= 500 THEN 'backoff' WHEN m LIKE 'xml%' OR m LIKE 'json%' THEN 'mark_broken' WHEN m LIKE '%timeout' THEN 'backoff' ELSE 'none' END AS action FROM c
""")
def classify_errors(spark, d):
    said = ["http 503", "fetch: http 404", "status 429 slow down", "xml syntax error", "dial: timeout", "http: 403", "status: 301", "json unexpected end", "odd"]
    m = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 9 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "web").otherwise("api").alias("t"), m.alias("m")).withColumn("status", rules.status_code("m"))
    return e.select("event_id", "status", rules.classify_error(F.col("t"), F.col("status"), F.col("m")).alias("x")).select("event_id", "status", "x.*")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS page, coalesce(json_extract_string(props, '$.ref'), '') AS ref FROM events""")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.lit("")).alias("page"), F.coalesce(F.get_json_object("props", "$.ref"), F.lit("")).alias("ref"))


@query("SELECT page_id, sha256(html) AS body_hash, page_id % 3 <> 0 AS changed FROM pages")
def changed_bodies(spark, d):
    p = table(spark, d, "pages").withColumn("source_id", F.col("page_id").cast("string"))
    s = p.select(F.col("source_id").alias("id"), F.when(F.col("page_id") % 3 == 0, text.sha256("html")).when(F.col("page_id") % 3 == 1, F.lit("")).otherwise(F.lit("other")).alias("last_hash"))
    return state.changed(p, s).select("page_id", "body_hash", "changed")


@query("""WITH v AS (SELECT doc_id, string_split(source || ' ' || lang || ' ' || CAST(doc_id % 100 AS VARCHAR) || ' x', ' ') AS w FROM documents)
    SELECT doc_id, '"' || array_to_string(w, ' ') || '"' AS phrase, array_to_string(w[1:2], ' ') AS first_half, array_to_string(w[3:4], ' ') AS second_half FROM v""")
def query_variants(spark, d):
    q = F.concat_ws(" ", "source", "lang", (F.col("doc_id") % 100).cast("string"), F.lit("x"))
    v = text.query_variants(q)
    return table(spark, d, "documents").select("doc_id", F.get(v, F.lit(0)).alias("phrase"), F.get(v, F.lit(1)).alias("first_half"), F.get(v, F.lit(2)).alias("second_half"))


@query("""SELECT doc_id, CAST(CASE WHEN n_chars <= 0 THEN 0.0 ELSE 1.0 + CASE WHEN n_chars <= 100 THEN 0 ELSE len(list_filter(generate_series(0, 40), lambda k: floor(n_chars / pow(2, k)) > 100)) END END AS DOUBLE) AS scale FROM documents""")
def log_scale(spark, d):
    return table(spark, d, "documents").select("doc_id", text.log_scale("n_chars").alias("scale"))


# -- vectors ----------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
    SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id <> 7) ORDER BY score DESC, vec_id LIMIT 10""")
def vector_similar(spark, d):
    return vectors.similar_to(table(spark, d, "embeddings"), 7).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT q.vec_id AS query, v.vec_id AS vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
    SELECT query, vec_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS INTEGER) AS place FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 5""")
def vector_neighbours(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.neighbours(v, v.where("vec_id % 50 = 0"), 5).withColumn("score", F.round("score", 6))


@query()
def vector_cells(spark, d):
    v = table(spark, d, "embeddings")
    cells = vectors.fit_cells(v, recall=0.95, k=5)
    return vectors.near_in_cells(vectors.in_cells(v, cells), v.where("vec_id % 50 = 0"), cells, 5).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"))


@query("SELECT count(*) AS count, CAST(max(len(embedding)) AS INTEGER) AS dimension, false AS needs_rebuild FROM embeddings")
def vector_stats(spark, d):
    return vectors.index_stats(table(spark, d, "embeddings"))


# -- streams over tables ----------------------------------------------------------------------------------------------


def records(spark, d):
    e = table(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, ("attr", "text", "insert", "attr", "remove"))), (F.length("event_type") % 5 + 1).cast("int"))
    return e.select((F.col("user_id")).cast("string").alias("page_id"), millis("ts").alias("ts_ms"), F.col("event_id").alias("n"), F.when(F.col("event_id") % 2 == 0, "cdp").otherwise("js").alias("source"), F.concat(F.lit("/x"), (F.col("event_id") % 2).cast("string")).alias("xpath"), op.alias("op"), F.lit("class").alias("name"), F.col("event_id").cast("string").alias("value"), (F.col("event_id") - 1).cast("string").alias("old_value"))


RECORDS_SQL = "r AS (SELECT CAST(user_id AS VARCHAR) AS page_id, (epoch_us(ts) // 1000) AS ts_ms, event_id AS n, '/x' || CAST(event_id % 2 AS VARCHAR) AS xpath, (['attr', 'text', 'insert', 'attr', 'remove'])[length(event_type) % 5 + 1] AS op, CAST(event_id AS VARCHAR) AS value, CAST(event_id - 1 AS VARCHAR) AS old_value FROM events)"


@query(f"""WITH {RECORDS_SQL}, b AS (SELECT *, CASE WHEN coalesce(ts_ms - lag(ts_ms) OVER w >= 3600000, true) THEN 1 ELSE 0 END AS f FROM r WINDOW w AS (PARTITION BY page_id ORDER BY ts_ms, n)),
    s AS (SELECT *, sum(f) OVER (PARTITION BY page_id ORDER BY ts_ms, n) AS batch FROM b)
    SELECT page_id, CAST(batch AS BIGINT) AS batch, count(*) AS records, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM s GROUP BY page_id, batch""")
def debounce_sessions(spark, d):
    q = mutations.quiet_batches(records(spark, d), gap_ms=3_600_000)
    return q.groupBy("page_id", F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("records"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT *, CASE WHEN op IN ('attr', 'text') THEN op || xpath END AS run FROM r), b AS (SELECT *, CASE WHEN run IS NULL OR run IS DISTINCT FROM lag(run) OVER w THEN 1 ELSE 0 END AS f FROM k WINDOW w AS (PARTITION BY page_id ORDER BY ts_ms, n)),
    g AS (SELECT *, sum(f) OVER (PARTITION BY page_id ORDER BY ts_ms, n) AS g FROM b)
    SELECT page_id, max_by(n, (ts_ms, n)) AS n, max_by(op, (ts_ms, n)) AS op, max_by(value, (ts_ms, n)) AS value, min_by(old_value, (ts_ms, n)) AS old_value FROM g GROUP BY page_id, g""")
def compress_runs(spark, d):
    return mutations.compress(records(spark, d), scope=("page_id",)).select("page_id", "n", "op", "value", "old_value")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS page_id, CAST(event_id AS VARCHAR) AS id, (epoch_us(ts) // 1000) AS t, event_type FROM events)
    SELECT b.page_id, b.id, (SELECT max_by(s.id, (s.t, s.id)) FROM e s WHERE s.page_id = b.page_id AND s.event_type = 'signup' AND s.t <= b.t) AS snapshot_ref FROM e b WHERE b.event_type <> 'signup'""")
def snapshot_chain(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("page_id"), F.col("event_id").cast("string").alias("id"), millis("ts").alias("timestamp"), "event_type")
    return mutations.with_snapshots(e.where("event_type <> 'signup'"), e.where("event_type = 'signup'")).select("page_id", "id", "snapshot_ref")


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT *, '/html/body/' || CASE n % 4 WHEN 0 THEN 'nav' WHEN 1 THEN 'nav/a[2]' WHEN 2 THEN 'navigation/p' ELSE 'article/p' END AS node FROM r)
    SELECT page_id, n, node FROM e WHERE NOT (node = '/html/body/nav' OR starts_with(node, '/html/body/nav/'))""")
def records_outside(spark, d):
    """Records of nodes that are not in a page's navigation."""
    places = F.element_at(F.array(*map(F.lit, ("nav", "nav/a[2]", "navigation/p", "article/p"))), (F.col("n") % 4 + 1).cast("int"))
    r = records(spark, d).withColumn("node", F.concat(F.lit("/html/body/"), places))
    return mutations.outside(r, ["/html/body/nav"], "node").select("page_id", "n", "node")


@query(f"WITH {RECORDS_SQL} SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY ts_ms, n) AS seq FROM r")
def batch_sequence(spark, d):
    return mutations.numbered(records(spark, d), order=("ts_ms", "n")).select("page_id", "n", "seq")


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT page_id, ts_ms, n, op, '/x' || CAST(n // 2 % 2 AS VARCHAR) AS xpath, n % 2 = 0 AS cdp FROM r),
    o AS (SELECT *, CASE WHEN cdp THEN max(ts_ms) FILTER (NOT cdp) OVER w ELSE max(ts_ms) FILTER (cdp) OVER w END AS other FROM e WINDOW w AS (PARTITION BY page_id, xpath, op ORDER BY ts_ms, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, last_value(CASE WHEN other IS NULL OR ts_ms - other > 3600000 THEN cdp END IGNORE NULLS) OVER (PARTITION BY page_id, xpath, op ORDER BY ts_ms, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leader FROM o)
    SELECT page_id, CASE WHEN cdp THEN 'cdp' ELSE 'js' END AS source, count(*) AS kept, max(n) AS last FROM l WHERE NOT cdp OR leader GROUP BY page_id, cdp""")
def echo_removal(spark, d):
    r = records(spark, d).withColumn("xpath", F.concat(F.lit("/x"), (F.floor(F.col("n") / 2) % 2).cast("string")))  # both sources tell of each path
    return mutations.drop_echoes_batch(r, tolerance=3_600_000, stretch=24 * 3_600_000).groupBy("page_id", "source").agg(F.count("*").alias("kept"), F.max("n").alias("last"))


more.register(query, table)
retrieval.register(query, table)
changes.register(query, sys.modules[__name__])
