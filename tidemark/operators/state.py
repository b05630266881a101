"""State of sources, rules, profiles and corrections: what row-level changes of a mutable store become on tables.

Each function takes a table and gives the table after the change; `now` is always passed in (epoch milliseconds). A change
names its rows by a condition or by a table of keys, and right-hand sides see the old row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text, urls

HOUR, DAY = 3_600_000, 86_400_000
MOST_SOURCES = 1000
#: Fixed values.
BROKEN = ("error", "extract_error", "broken")
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
)


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows where the condition holds with new values; all others as they are."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(hit, values[c].cast(df.schema[c].dataType.simpleString())).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def upsert(df: DataFrame, rows: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows put over those of df with the same key; columns named in keep stay as df has them where a row existed."""
    old = df.select(F.col(key).alias("_key"), F.lit(True).alias("_old"), *(F.col(c).alias(f"_{c}") for c in keep))
    new = rows.join(old, F.col(key) == F.col("_key"), "left")
    new = new.select(*(F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in df.columns))
    return df.join(rows.select(key), key, "left_anti").select(*df.columns).unionByName(new)


def delete(df: DataFrame, where: Column, children: dict[str, tuple[DataFrame, str]] | None = None, key: str = "id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """df without the rows, and the child tables (name -> table, foreign key) without what pointed at them."""
    gone = df.where(where).select(F.col(key).alias("_gone"))
    left = df.where(~F.coalesce(where, F.lit(False)))
    return left, {name: child.join(gone, F.col(fk) == F.col("_gone"), "left_anti") for name, (child, fk) in (children or {}).items()}


def detach(child: DataFrame, fk: str, gone: DataFrame, key: str = "id") -> DataFrame:
    """child with its foreign key null where it pointed at a removed row (of folders: rules and sub-folders stay)."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return child.join(g, F.col(fk) == F.col("_gone"), "left").withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone")


# -- sources ----------------------------------------------------------------------------------------------------------


def source_defaults(df: DataFrame, now: int) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.withColumns({
        "source_type": F.when(empty("source_type"), "web").otherwise(F.col("source_type")), "fetch_interval": F.when(F.coalesce(F.col("fetch_interval"), F.lit(0)) == 0, HOUR).otherwise(F.col("fetch_interval")),
        "config_json": F.when(empty("config_json"), "{}").otherwise(F.col("config_json")), "last_status": F.when(empty("last_status"), "pending").otherwise(F.col("last_status")),
        "created_at": F.coalesce("created_at", F.lit(now)), "updated_at": F.coalesce("updated_at", F.lit(now)),
    })


def add_sources(sources: DataFrame, new: DataFrame, now: int, most: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """sources with the valid new rows, and the rejected rows with their reasons."""
    taken, bad = admit_sources(sources, new, now, most)
    return sources.unionByName(taken), bad


def admit_sources(sources: DataFrame, new: DataFrame, now: int, most: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """The valid new rows, and the rejected rows with their reasons.

    Defaults, validation, normal form of the URL, quota, then duplicates by URL (of the store or of an earlier new row).
    """
    n = source_defaults(new, now).withColumn("raw_url", F.col("url")).withColumn("url", F.when(F.col("source_type") == "question", F.col("url")).otherwise(urls.normalise("url")))
    n = n.withColumn("errors", rules.validate_source(F.col("name"), F.coalesce("url", F.lit("")), F.col("source_type"), F.col("fetch_interval"), F.col("config_json")))
    first = F.row_number().over(Window.partitionBy("url").orderBy("created_at", "id"))
    n = n.withColumn("turn", first).join(sources.select("url", F.lit(True).alias("known")), "url", "left")
    n = n.withColumn("errors", F.when((F.size("errors") == 0) & (F.col("known") | (F.col("turn") > 1)), F.array(F.lit("duplicate"))).otherwise(F.col("errors")))
    good = n.where(F.size("errors") == 0)
    room = max(0, most - sources.count())
    # the first ones that there is room for: every task keeps as many, and at most `most` meet
    first_ones = good.orderBy("created_at", "id").limit(room).select(F.col("url").alias("_url"))
    taken = good.join(first_ones, good.url == F.col("_url"), "left_semi").select(*sources.columns)
    bad = n.where(F.size("errors") > 0).select("id", F.col("raw_url").alias("url"), "errors")
    over = good.join(first_ones, good.url == F.col("_url"), "left_anti").select("id", F.col("raw_url").alias("url"), F.array(F.lit("quota")).alias("errors"))
    return taken, bad.unionByName(over)


def merge_source(old: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Name, type, URL and interval keep their value where a change leaves them empty; enabled and config are taken as they come."""
    c = changes.select("id", *(F.col(x).alias(f"n_{x}") for x in ("name", "url", "source_type", "fetch_interval", "enabled", "config_json")))
    j = old.join(c, "id", "left")
    hit = F.col("n_enabled").isNotNull() | F.col("n_name").isNotNull()
    text_of = lambda x: F.when(F.coalesce(F.col(f"n_{x}"), F.lit("")) != "", F.col(f"n_{x}")).otherwise(F.col(x))
    new = {
        "name": text_of("name"), "source_type": text_of("source_type"), "url": F.when(F.coalesce(F.col("n_url"), F.lit("")) != "", urls.normalise("n_url")).otherwise(F.col("url")),
        "fetch_interval": F.when(F.coalesce(F.col("n_fetch_interval"), F.lit(0)) != 0, F.col("n_fetch_interval")).otherwise(F.col("fetch_interval")),
        "enabled": F.coalesce(F.col("n_enabled"), F.lit(False)), "config_json": F.coalesce(F.col("n_config_json"), F.lit("")), "updated_at": F.lit(now),
    }
    return j.select(*(F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in old.columns))


def fetch_success(df: DataFrame, where: Column, body_hash: Column, now: int) -> DataFrame:
    return update(df, where, last_fetched_at=F.lit(now), last_hash=body_hash, last_status=F.lit("ok"), last_error=F.lit(""), fail_count=F.lit(0), updated_at=F.lit(now))


def fetch_unchanged(df: DataFrame, where: Column, now: int) -> DataFrame:
    return update(df, where, last_fetched_at=F.lit(now), last_status=F.lit("unchanged"), fail_count=F.lit(0), updated_at=F.lit(now))


def fetch_error(df: DataFrame, where: Column, message: Column, now: int) -> DataFrame:
    return update(df, where, last_fetched_at=F.lit(now), last_status=F.lit("error"), last_error=message, fail_count=F.col("fail_count") + 1, updated_at=F.lit(now))


def reset(df: DataFrame, where: Column, now: int) -> DataFrame:
    return update(df, where, fail_count=F.lit(0), last_status=F.lit("pending"), last_error=F.lit(""), fetch_interval=F.coalesce("original_fetch_interval", "fetch_interval"), original_fetch_interval=F.lit(None), updated_at=F.lit(now))


def backoff(df: DataFrame, where: Column, now: int, most: int = DAY) -> DataFrame:
    """Twice the interval up to a ceiling; the interval before the first doubling is kept."""
    return update(df, where, original_fetch_interval=F.coalesce("original_fetch_interval", "fetch_interval"), fetch_interval=F.least(F.col("fetch_interval") * 2, F.lit(most)), updated_at=F.lit(now))


def move_url(df: DataFrame, where: Column, url: Column, now: int) -> DataFrame:
    return update(df, where, url=url, fail_count=F.lit(0), last_status=F.lit("pending"), updated_at=F.lit(now))


def set_status(df: DataFrame, where: Column, status: str, now: int) -> DataFrame:
    return update(df, where, last_status=F.lit(status), updated_at=F.lit(now))


def next_agent(tried: Column, current: Column, agents: tuple[str, ...] = AGENTS) -> Column:
    """The first agent that is neither tried nor in use; '' when there is none left."""
    left = F.array_except(F.array(*map(F.lit, agents)), F.array_union(F.coalesce(tried, F.array().cast("array<string>")), F.array(F.coalesce(current, F.lit("")))))
    return F.coalesce(F.get(left, F.lit(0)), F.lit(""))


def set_keys(config: Column, values: Column, *keys: str) -> Column:
    """A JSON object with these keys from a struct of values, and its other keys as they are."""
    old = F.coalesce(F.from_json(config, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    new = F.parse_json(F.to_json(values))
    entries = F.create_map(*(x for k in keys for x in (F.lit(k), F.variant_get(new, f"$.{k}", "variant"))))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*keys)), entries))


def repair(sources: DataFrame, failures: DataFrame, now: int, most: int = DAY) -> DataFrame:
    """sources after their failures (id, status, message): classified, then backed off, given another agent, or marked broken.

    A redirect does nothing, for nothing tells its target. An agent's turn is kept in user_agent and tried_uas of the
    configuration, whose other keys stay as they are; a configuration that is no JSON object is taken as empty.
    """
    f = failures.select("id", F.col("status").alias("_status"), F.col("message").alias("_message"))
    j = sources.join(f, "id", "left").withColumn("_do", rules.classify_error(F.col("source_type"), F.coalesce("_status", F.lit(0)), F.coalesce("_message", F.lit("")))["action"])
    j = j.withColumn("_do", F.when(F.col("_message").isNull() & F.col("_status").isNull(), "none").otherwise(F.col("_do")))
    config = F.from_json("config_json", "user_agent string, tried_uas array<string>")
    agent = next_agent(config["tried_uas"], config["user_agent"])
    tried = F.array_append(F.coalesce(config["tried_uas"], F.array().cast("array<string>")), F.coalesce(config["user_agent"], F.lit("")))
    turned = set_keys(F.col("config_json"), F.struct(agent.alias("user_agent"), F.array_distinct(F.filter(tried, lambda x: x != "")).alias("tried_uas")), "user_agent", "tried_uas")
    slow, turn = F.col("_do").isin("backoff", "increase_rate"), (F.col("_do") == "rotate_ua") & (agent != "")
    broken = (F.col("_do") == "mark_broken") | ((F.col("_do") == "rotate_ua") & (agent == ""))
    # at once, for the status depends on the configuration before its change
    out = j.withColumns({"config_json": F.when(turn, turned).otherwise(F.col("config_json")), "last_status": F.when(broken, "broken").otherwise(F.col("last_status"))})
    return backoff(out, slow, now, most).select(*sources.columns)


def normalise_urls(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One source per normal URL (the oldest), with the URL rewritten, and the ids that went."""
    n = sources.withColumn("_url", F.coalesce(urls.normalise("url"), "url"))
    n = n.withColumn("_turn", F.row_number().over(Window.partitionBy("_url").orderBy("created_at", "id")))
    kept = n.where("_turn = 1").withColumn("url", F.col("_url")).select(*sources.columns)
    return kept, n.where("_turn > 1").select("id")


# -- questions --------------------------------------------------------------------------------------------------------


def question_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({"schedule_ms": F.when(F.coalesce(F.col("schedule_ms"), F.lit(0)) == 0, DAY).otherwise(F.col("schedule_ms")), "max_results": F.when(F.coalesce(F.col("max_results"), F.lit(0)) == 0, 20).otherwise(F.col("max_results")), "channels": F.coalesce("channels", F.lit("[]"))})


def question_source(questions: DataFrame, now: int) -> DataFrame:
    """The source that stands behind each question."""
    q = question_defaults(questions)
    long = F.octet_length("text") > 83
    cut = F.regexp_replace(F.decode(F.substring(F.encode("text", "UTF-8"), 1, 80), "ISO-8859-1"), "[\\x{c0}-\\x{ff}][\\x{80}-\\x{bf}]{0,2}$", "")
    short = F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")
    name = F.concat(F.lit("Q: "), F.when(long, F.concat(short, F.lit("..."))).otherwise(F.col("text")))
    return q.select("id", name.alias("name"), F.concat(F.lit("question://"), "id").alias("url"), F.lit("question").alias("source_type"), F.col("schedule_ms").alias("fetch_interval"), "enabled", F.lit(now).alias("created_at"))


def question_run(df: DataFrame, where: Column, found: Column, now: int) -> DataFrame:
    return update(df, where, last_run_at=F.lit(now), last_result_count=found, total_results=F.col("total_results") + found)


def promote_search(searches: DataFrame, now: int) -> DataFrame:
    """A logged search (id, query, channels) as a tracked question."""
    q = searches.select("id", F.col("query").alias("text"), F.col("query").alias("keywords"), F.to_json("channels").alias("channels"), F.lit(None).cast("long").alias("schedule_ms"), F.lit(None).cast("int").alias("max_results"), F.lit(True).alias("follow_links"), F.lit(True).alias("enabled"), F.lit(now).alias("created_at"))
    return question_defaults(q)


# -- rules and content ------------------------------------------------------------------------------------------------


def rule_success(df: DataFrame, where: Column, now: int) -> DataFrame:
    return update(df, where, last_success=F.lit(now), fail_count=F.lit(0))


def rule_failure(df: DataFrame, where: Column) -> DataFrame:
    return update(df, where, fail_count=F.col("fail_count") + 1)


def rule_update(df: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Changed columns of a rule; its version goes up by one."""
    new = [c for c in changes.columns if c != "id"]
    j = df.join(changes.select("id", *(F.col(c).alias(f"_{c}") for c in new), F.lit(True).alias("_hit")), "id", "left")
    over = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in new} | {"version": F.when(F.col("_hit"), F.col("version") + 1).otherwise(F.col("version")), "updated_at": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at"))}
    return j.select(*(over[c].alias(c) if c in over else F.col(c) for c in df.columns))


def insert_new(stored: DataFrame, new: DataFrame, scope: str, digest: str = "content_hash", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows of new whose (scope, hash) is not stored yet; of several new ones the first."""
    first = F.row_number().over(Window.partitionBy(scope, digest).orderBy(*order))
    return new.withColumn("_turn", first).where("_turn = 1").drop("_turn").join(stored.select(scope, digest).distinct(), [scope, digest], "left_anti").select(*new.columns)


def expired(df: DataFrame, now: int) -> Column:
    return F.coalesce(F.col("expires_at") < now, F.lit(False))


# -- profiles, corrections, reputation --------------------------------------------------------------------------------


def publish_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles put over those of the same URL pattern, which keep their id."""
    return upsert(profiles, new, "url_pattern", keep=("id",))


def use_profile(df: DataFrame, where: Column) -> DataFrame:
    return update(df, where, total_uses=F.col("total_uses") + 1)


def profile_success(df: DataFrame, where: Column) -> DataFrame:
    return update(df, where, success_rate=rules.ema_success(F.col("success_rate")))


def profile_failure(df: DataFrame, where: Column) -> DataFrame:
    return update(df, where, success_rate=rules.ema_failure(F.col("success_rate")), total_repairs=F.col("total_repairs") + 1)


def report_failure(df: DataFrame, where: Column) -> DataFrame:
    """A report lowers the rate as a failure does, but counts no repair."""
    return update(df, where, success_rate=rules.ema_failure(F.col("success_rate")))


def add_contributor(df: DataFrame, where: Column, who: Column) -> DataFrame:
    return update(df, where, contributors=F.when(F.array_contains("contributors", who), F.col("contributors")).otherwise(F.array_append("contributors", who)))


def reputation(corrections: DataFrame) -> DataFrame:
    """Counters per instance, derived from its corrections (validated: 1 accepted, -1 rejected, 0 pending)."""
    n = lambda v: F.count(F.when(F.col("validated") == v, 1))
    return corrections.groupBy("instance_id").agg(n(1).alias("corrections_accepted"), n(-1).alias("corrections_rejected"), n(0).alias("corrections_pending"), F.max("created_at").alias("last_active"), F.lit(0).alias("domains_covered"))


def submit_corrections(corrections: DataFrame, new: DataFrame, automatic: bool = True) -> DataFrame:
    """corrections with the new ones, accepted at once where the instance's history so far earns it."""
    r = reputation(corrections).select("instance_id", rules.auto_accept(F.col("corrections_accepted"), F.col("corrections_rejected")).alias("_trusted"))
    judged = new.join(r, "instance_id", "left").withColumn("validated", F.when(F.coalesce("_trusted", F.lit(False)) & F.lit(automatic), 1).otherwise(0))
    return corrections.unionByName(judged.select(*corrections.columns))


def decide(corrections: DataFrame, profiles: DataFrame, accepted: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corrections and profiles after ids were accepted or rejected; decided ones are left alone.

    Of an accepted correction the extractors become the profile's, and it counts as a repair; the latest one of a profile wins.
    """
    yes, no = accepted.select("id", F.lit(1).alias("_say")), rejected.select("id", F.lit(-1).alias("_say"))
    say = yes.unionByName(no).groupBy("id").agg(F.max("_say").alias("_say"))
    j = corrections.join(say, "id", "left").withColumn("_new", F.when((F.col("validated") == 0) & F.col("_say").isNotNull(), F.col("_say")).otherwise(F.col("validated")))
    taken = j.where((F.col("validated") == 0) & (F.col("_new") == 1))
    latest = taken.groupBy("profile_id").agg(F.max(F.struct("created_at", "id", "new_extractors")).alias("x"), F.count("*").alias("n"))
    p = profiles.join(latest.select(F.col("profile_id").alias("_id"), F.col("x.new_extractors").alias("_new"), F.col("n").alias("_n")), F.col("id") == F.col("_id"), "left")
    over = {"extractors": F.coalesce("_new", "extractors"), "total_repairs": F.col("total_repairs") + F.coalesce("_n", F.lit(0))}
    return j.withColumn("validated", F.col("_new")).select(*corrections.columns), p.select(*(over[c].alias(c) if c in over else F.col(c) for c in profiles.columns))


def ema_fold(events: DataFrame, key: str, order: tuple[str, ...], good: Column, start: float = 1.0, bucket: int = DAY) -> DataFrame:
    """Success rate of each key after its events in order (the first column of order is a number), each a success or a failure.

    A step is r * 0.95 (+ 0.05 for a success) and keeps a rate within 0 and 1, so steps compose: a stretch of n events
    (those of a bucket of the first order column) turns r into 0.95 ** n * r + c, and so do stretches one after another.
    No history is gathered in a row or a list.
    """
    e = events.select(key, (F.floor(F.col(order[0]) / bucket)).alias("_stretch"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), good.alias("_good"))
    later = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(*(F.desc(f"_o{i}") for i in range(len(order))))) - 1
    gain = F.when(F.col("_good"), 0.05 * F.pow(F.lit(0.95), "_later")).otherwise(0.0)
    part = e.withColumn("_later", later).groupBy(key, "_stretch").agg(F.count("*").alias("n"), F.sum(gain).alias("c"))
    after = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = part.withColumn("after", after).groupBy(key).agg(F.sum(F.col("c") * F.pow(F.lit(0.95), "after")).alias("c"), F.sum("n").alias("events"))
    return out.select(key, (F.lit(start) * F.pow(F.lit(0.95), "events") + F.col("c")).alias("success_rate"), "events")


# -- filters ----------------------------------------------------------------------------------------------------------


def due_sources(df: DataFrame, now: int, most_failures: int = 10) -> DataFrame:
    at = F.col("last_fetched_at")
    return df.where(F.col("enabled") & (F.col("fail_count") < most_failures) & (at.isNull() | (at + F.col("fetch_interval") <= now))).orderBy(at.asc_nulls_first(), "id")


def due_questions(df: DataFrame, now: int) -> DataFrame:
    at = F.col("last_run_at")
    return df.where(F.col("enabled") & (at.isNull() | (at + F.col("schedule_ms") <= now)))


def broken_sources(df: DataFrame) -> DataFrame:
    return df.where(F.col("last_status").isin(*BROKEN) | (F.col("fail_count") > 0)).orderBy(F.desc("fail_count"), "id")


def sweep(df: DataFrame, probes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Sources after probing the broken ones (questions and documents aside), and how many were probed and came back."""
    tried = broken_sources(df).where(~F.col("source_type").isin("question", "document")).join(probes.select("id", "status_code"), "id")
    well = tried.where(F.col("status_code").between(200, 399)).select("id", F.lit(True).alias("_well"))
    out = reset(df.join(well, "id", "left"), F.col("_well"), now).select(*df.columns)
    return out, tried.agg(F.count("*").alias("probed"), F.count(F.when(F.col("status_code").between(200, 399), 1)).alias("recovered"))


def stale_rules(df: DataFrame, now: int, freshness: int = HOUR, most_failures: int = 10) -> DataFrame:
    fresh = F.coalesce(F.col("last_success") > now - freshness, F.lit(False))
    return df.where(F.col("enabled") & (F.col("fail_count") < most_failures) & ~fresh)


def changed(pages: DataFrame, sources: DataFrame, body: str = "html", key: str = "source_id") -> DataFrame:
    """pages with their body's hash, and whether it differs from the source's last one (or there was none)."""
    p = pages.withColumn("body_hash", text.sha256(body)).join(sources.select(F.col("id").alias(key), "last_hash"), key, "left")
    return p.withColumn("changed", (F.coalesce("last_hash", F.lit("")) == "") | (F.col("last_hash") != F.col("body_hash")))
