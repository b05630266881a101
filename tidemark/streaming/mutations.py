"""Streams of page mutations: batches by quiet time, compression, removal of echoes, consumers. Batch forms share the rules.

Batches are session windows in event time: rows that come later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state as store

GAP_MS, MOST, ECHO_MS = 250, 1000, 50
SIGNIFICANT = ("doc_reset", "insert", "remove")
MERGED = ("attr", "text")


def quiet_batches(records: DataFrame, key: str = "page_id", time: str = "ts_ms", tie: str = "n", gap_ms: int = GAP_MS, most: int = MOST) -> DataFrame:
    """records with batch: a new one after more than gap_ms without a record, and after every `most` records."""
    w = Window.partitionBy(key).orderBy(time, tie)
    fresh = F.coalesce((F.col(time) - F.lag(time).over(w) >= gap_ms).cast("int"), F.lit(1))
    r = records.withColumn("_s", F.sum(fresh).over(w))
    r = r.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_s").orderBy(time, tie)))
    r = r.withColumn("_p", F.floor((F.col("_i") - 1) / most))
    return r.withColumn("batch", F.dense_rank().over(Window.partitionBy(key).orderBy("_s", "_p"))).drop("_s", "_i", "_p")


def compress(records: DataFrame, scope: tuple[str, ...] = ("page_id", "batch"), order: tuple[str, ...] = ("ts_ms", "n")) -> DataFrame:
    """Runs of attr records of one path and name, and of text records of one path, as their last record with the first one's old value.

    All other records stay as they are, and end runs.
    """
    w = Window.partitionBy(*scope).orderBy(*order)
    run = F.when(F.col("op") == "attr", F.struct(F.lit("attr"), "xpath", F.coalesce("name", F.lit("")))).when(F.col("op") == "text", F.struct(F.lit("text"), "xpath", F.lit("")))
    r = records.withColumn("_run", run).withColumn("_new", (F.col("_run").isNull() | ~F.col("_run").eqNullSafe(F.lag("_run").over(w))).cast("int"))
    r = r.withColumn("_g", F.sum("_new").over(w)).drop("_run", "_new")
    cols = [c for c in records.columns if c not in scope]
    out = r.groupBy(*scope, "_g").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x"), F.min_by(F.struct("old_value"), F.struct(*order)).alias("f"))
    merged = F.when(F.col("x.op").isin(*MERGED), F.col("f.old_value")).otherwise(F.col("x.old_value"))
    return out.select(*(F.col(c) if c in scope else merged.alias(c) if c == "old_value" else F.col(f"x.{c}").alias(c) for c in records.columns))


def outside(records: DataFrame, elements: list[str], path: str = "xpath") -> DataFrame:
    """records whose node is none of the elements (paths) and lies in none of them; a record without a path stays."""
    p = F.coalesce(F.col(path), F.lit(""))
    inside = F.lit(False)
    for e in elements:
        inside = inside | (p == e) | p.startswith(e.rstrip("/") + "/")
    return records.where(~inside)


def numbered(batches: DataFrame, key: str = "page_id", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """batches with seq, counting from 1 for each page."""
    return batches.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def with_snapshots(batches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """batches with the id of the page's last snapshot before them: an as-of join by a window over both."""
    both = batches.withColumn("_snap", F.lit(None).cast("string")).unionByName(snapshots.select(F.col("page_id"), F.col("timestamp"), F.col("id").alias("_snap")), allowMissingColumns=True)
    w = Window.partitionBy("page_id").orderBy("timestamp", F.col("_snap").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("snapshot_ref", F.last("_snap", ignorenulls=True).over(w)).where(F.col("_snap").isNull()).drop("_snap")


def significant(records: Column) -> Column:
    return F.exists(records, lambda r: r["op"].isin(*SIGNIFICANT))


def split_at_resets(records: DataFrame, key: str = "page_id", order: tuple[str, ...] = ("ts_ms", "n")) -> DataFrame:
    """records with epoch: one more from each document reset on."""
    w = Window.partitionBy(key).orderBy(*order)
    return records.withColumn("epoch", F.sum((F.col("op") == "doc_reset").cast("int")).over(w))


def debounce(stream: DataFrame, time: str = "ts", gap: str = "250 milliseconds", late: str = "10 seconds", key: str = "page_id") -> DataFrame:
    """A stream of records as batches of quiet time: page, window, and the records in order."""
    r = stream.withWatermark(time, late)
    cols = [c for c in stream.columns if c not in (key, time)]
    return r.groupBy(key, F.session_window(time, gap)).agg(F.array_sort(F.collect_list(F.struct(time, *cols))).alias("records")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "records")


def drop_echoes(stream: DataFrame, tolerance: int = ECHO_MS, late: str = "10 seconds") -> DataFrame:
    """A stream without records of the browser protocol that the page's own script has told within the tolerance, in event time of ts_ms."""
    from .stateful import remove_echoes  # which imports this module

    # the first watermark is at 0, and would take a record of that moment for a late one
    return remove_echoes(stream.withColumn("_ts", F.timestamp_millis(F.col("ts_ms") + 1)), late, tolerance, "_ts")


def drop_echoes_batch(records: DataFrame, tolerance: int = ECHO_MS, stretch: int = 3_600_000) -> DataFrame:
    """The same over a table, without a bound on what a page is remembered by.

    Per page, path, operation and name one source leads: the one whose records are remembered. A record with none of the
    other source within the tolerance before it makes its own source the leading one, so the leader is the source of the
    last such record, and records of the other source are echoes. Windows over stretches of time find both: a record also
    counts in the stretches that begin within the tolerance after it, and each stretch hands its last leader on in one
    row, so no page's records gather in one task.
    """
    cdp, at = F.coalesce(F.col("source") == "cdp", F.lit(False)), F.col("ts_ms")
    r = records.withColumn("_k", F.struct("page_id", "xpath", "op", "name")).withColumn("_cdp", cdp).withColumn("_own", F.floor(at / stretch))
    r = r.withColumn("_s", F.explode(F.sequence("_own", F.floor((at + tolerance) / stretch))))
    inside = Window.partitionBy("_k", "_s").orderBy("ts_ms", "n")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("_cdp"), F.max(F.when(~F.col("_cdp"), at)).over(before)).otherwise(F.max(F.when(F.col("_cdp"), at)).over(before))
    r = r.withColumn("_other", other).where("_s = _own").withColumn("_leads", F.when(F.col("_other").isNull() | (at - F.col("_other") > tolerance), F.col("_cdp")))
    last = F.max(F.when(F.col("_leads").isNotNull(), F.struct("ts_ms", "n", "_leads"))).alias("l")
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    handed = r.groupBy("_k", "_s").agg(last).select("_k", "_s", F.last("l", ignorenulls=True).over(earlier)["_leads"].alias("_handed"))
    leader = F.coalesce(F.last("_leads", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_handed"))
    return r.join(handed, ["_k", "_s"]).withColumn("_leader", leader).where(~F.col("_cdp") | F.col("_leader")).select(*records.columns)


# -- consumers --------------------------------------------------------------------------------------------------------


def consume_batches(batches: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Log entries and source pages of mutation batches; nothing is extracted from them."""
    log = batches.select(F.col("id").alias("batch_id"), "page_id", "page_url", F.when(significant(F.col("records")), "significant").otherwise("minor").alias("kind"), F.lit("done").alias("status"), F.lit(0).alias("extracted_count"), F.lit(now).alias("created_at"))
    pages = batches.groupBy("page_id").agg(F.max_by("page_url", "timestamp").alias("page_url"), F.lit("").alias("trust_level"), F.lit("").alias("dom_profile"), F.lit(now).alias("last_seen"), F.lit(now).alias("created_at"))
    return log, pages


def upsert_pages(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages put over the stored ones; only the time of creation stays."""
    return store.upsert(stored, pages, "page_id", keep=("created_at",))


def consume_snapshots(snapshots: DataFrame, rules: DataFrame, stored: DataFrame, least: int = 50) -> DataFrame:
    """New content of snapshots: every rule that matches extracts by its mode, texts are cleaned, empty and known ones go."""
    from ..functions import chunks, dom, text
    from ..operators import joins

    met = joins.match_rules(snapshots.withColumnRenamed("page_url", "url"), rules)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [dom.extract(r.html, r.r_extract_mode, list(r.r_selectors) if r.r_selectors is not None else [], least) for r in df.itertuples()]
            yield pd.DataFrame({"id": df["id"], "rule_id": df["r_id"], "page_url": df["url"], "title": [g["title"] for g in got], "raw": [g["text"] for g in got], "content_hash": [g["hash"] for g in got], "error": [g["error"] for g in got]}, dtype=object)

    out = met.select("id", "url", "html", "r_id", "r_extract_mode", "r_selectors").mapInPandas(run, "id string, rule_id string, page_url string, title string, raw string, content_hash string, error string")
    out = out.withColumn("extracted_text", text.clean("raw")).drop("raw").where(F.col("error").isNotNull() | (F.col("extracted_text") != ""))
    fresh = store.insert_new(stored, out.where(F.col("error").isNull()), "rule_id", order=("id",))
    return fresh.withColumn("chunks", chunks.chunk("extracted_text")).unionByName(out.where(F.col("error").isNotNull()), allowMissingColumns=True)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off what is there, one micro-batch after another, exactly once for a handler that is idempotent by batch number."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def every(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, period: str = "1 minute") -> StreamingQuery:
    """The scheduler's loop: the handler runs at once and then every period."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


# -- snapshots, profiles, levels --------------------------------------------------------------------------------------


def settled(records: DataFrame, navigations: DataFrame, quiet_ms: int = 500, key: str = "page_id", time: str = "ts_ms") -> DataFrame:
    """key, navigated, settled: when each navigation is followed by quiet_ms without a mutation, which is when a snapshot is due.

    A navigation that another one follows before the page is quiet has no such time.
    """
    both = records.select(key, F.col(time).alias("at"), F.lit(False).alias("nav")).unionByName(navigations.select(key, F.col(time).alias("at"), F.lit(True).alias("nav")))
    w = Window.partitionBy(key).orderBy("at", F.col("nav").desc())
    both = both.withColumn("next", F.lead("at").over(w)).withColumn("leg", F.sum(F.col("nav").cast("int")).over(w)).where("leg > 0")
    quiet = F.col("next").isNull() | (F.col("next") - F.col("at") >= quiet_ms)
    out = both.groupBy(key, "leg").agg(F.min("at").alias("navigated"), F.min(F.when(quiet, F.col("at") + quiet_ms)).alias("settled"))
    return out.select(key, "navigated", "settled")


def snapshot_times(pages: DataFrame, now: int, default_ms: int = 4 * store.HOUR) -> DataFrame:
    """Pages whose next periodic snapshot is due: those never taken, and those whose period has passed."""
    period = F.when(F.coalesce(F.col("snapshot_interval_ms"), F.lit(0)) > 0, F.col("snapshot_interval_ms")).otherwise(default_ms)
    return pages.where((F.col("status") == "active") & (F.col("last_snapshot_at").isNull() | (F.col("last_snapshot_at") + period <= now)))


def consume_profiles(profiles: DataFrame, rules: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """New rules for pages that no rule matches but whose profile names content selectors, and the pages seen.

    profiles: page_url, content_selectors, profile_json. The pages come with an empty page_id.
    """
    from ..operators import joins, tables

    p = profiles.withColumn("page_id", F.col("page_url")).withColumn("url", F.col("page_url"))
    known = joins.match_rules(p.select("page_id", "url"), rules).select("page_id").distinct()
    new = p.join(known, "page_id", "left_anti").where(F.size("content_selectors") > 0)
    made = new.select(tables.make_id("page_url").alias("id"), F.concat(F.lit("auto: "), "page_url").alias("name"), F.col("page_url").alias("url_pattern"), F.lit("").alias("page_id"), F.col("content_selectors").alias("selectors"), F.lit("css").alias("extract_mode"), F.lit("unverified").alias("trust_level"), F.lit(True).alias("enabled"), F.lit(0).alias("priority"), F.lit(1).alias("version"), F.lit(0).alias("fail_count"), F.lit(now).alias("created_at"))
    pages = profiles.select(F.lit("").alias("page_id"), "page_url", F.lit("").alias("trust_level"), F.col("profile_json").alias("dom_profile"), F.lit(now).alias("last_seen"), F.lit(now).alias("created_at"))
    return made, pages


def stealth_level(asked: Column, sufficient: Column) -> Column:
    """The level a page is watched at: a fixed one as it is; "auto" stays with plain HTTP (0) where that suffices, else a browser (1)."""
    return F.when(asked == "auto", F.when(F.coalesce(sufficient, F.lit(False)), 0).otherwise(1)).otherwise(asked.try_cast("int"))
