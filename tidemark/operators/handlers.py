"""Handlers of source types: from fetched bodies to new extractions, log rows and the sources' next state.

A handler takes (sources, bodies) of its type and gives items (source_id, content_hash, title, extracted_text, extracted_html,
url) and outcomes (source_id, status, error, body_hash). One pass serves all due sources of all tenants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dom, rules, text
from ..sources import feeds, files
from . import state, tables

Handler = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
ITEM = ("source_id", "content_hash", "title", "extracted_text", "extracted_html", "url")
OUTCOME = ("source_id", "status", "error", "body_hash")


def web(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The main text of a changed page; an unchanged body, a failed extraction and an empty text are outcomes of their own."""
    j = jobs.withColumn("body_hash", text.sha256("body")).withColumn("same", F.coalesce(F.col("last_hash") == F.col("body_hash"), F.lit(False)))
    got = j.where(~F.col("same")).withColumn("x", dom.extract_column("body")).withColumn("t", text.clean("x.text"))
    kind = F.when(F.col("x.error").isNotNull(), "extract_error").when(F.col("t") == "", "empty").otherwise("ok")
    got = got.withColumn("kind", kind)
    items = got.where("kind = 'ok'").select("source_id", F.col("x.hash").alias("content_hash"), F.col("x.title").alias("title"), F.col("t").alias("extracted_text"), F.col("x.html").alias("extracted_html"), "url")
    out = got.select("source_id", F.col("kind").alias("status"), F.col("x.error").alias("error"), "body_hash")
    same = j.where("same").select("source_id", F.lit("unchanged").alias("status"), F.lit(None).cast("string").alias("error"), "body_hash")
    return items, out.unionByName(same)


def _outcomes(jobs: DataFrame, errors: DataFrame) -> DataFrame:
    e = errors.groupBy("source_id").agg(F.min("error").alias("error"))
    j = jobs.select("source_id", text.sha256("body").alias("body_hash")).join(e, "source_id", "left")
    return j.select("source_id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", "body_hash")


def rss(jobs: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    e = feeds.read_feeds(jobs, "body", "source_id", most).withColumnRenamed("doc", "source_id")
    said = text.clean(F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.col("content")).otherwise(F.col("description")))
    items = e.where("error IS NULL").select("source_id", text.feed_key("guid", "link").alias("content_hash"), "title", said.alias("extracted_text"), F.lit("").alias("extracted_html"), F.col("link").alias("url"))
    return items, _outcomes(jobs, e.where("error IS NOT NULL").select("source_id", "error"))


def api(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of JSON answers, by the path and fields of each source's configuration, in one pass over all of them."""
    config = F.from_json("config_json", "result_path string, fields map<string,string>")
    read = feeds.read_shaped(jobs.select("source_id", "body", config.alias("c")).select(F.col("source_id").alias("doc"), "body", F.coalesce("c.result_path", F.lit("")).alias("path"), "c.fields"))
    items = read.where("error IS NULL AND trim(text) <> ''")
    items = items.select(F.col("doc").alias("source_id"), text.item_key("url", "title").alias("content_hash"), "title", text.clean("text").alias("extracted_text"), F.lit("").alias("extracted_html"), "url")
    return items, _outcomes(jobs, read.where("error IS NOT NULL").select(F.col("doc").alias("source_id"), "error"))


def document(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = files.read_documents(jobs.select(F.concat_ws("\x1f", "source_id", "url").alias("path"), F.col("body").cast("binary").alias("content")))
    docs = docs.withColumn("source_id", F.substring_index("path", "\x1f", 1)).withColumn("t", text.clean("raw_text"))
    items = docs.where("error IS NULL AND t <> ''").select("source_id", text.sha256("t").alias("content_hash"), "title", F.col("t").alias("extracted_text"), F.lit("").alias("extracted_html"), F.substring_index("path", "\x1f", -1).alias("url"))
    return items, _outcomes(jobs, docs.where("error IS NOT NULL").select("source_id", "error"))


def results(found: DataFrame, questions: DataFrame, most_first: bool = True) -> DataFrame:
    """Search results (question_id, engine_position, position, title, text, url) as items of the questions' sources.

    The cap of a question holds before duplicates go; an empty text falls back to the snippet by being the snippet.
    """
    w = Window.partitionBy("question_id").orderBy("engine_position", "position")
    f = found.join(questions.select(F.col("id").alias("question_id"), "max_results"), "question_id").withColumn("_turn", F.row_number().over(w))
    if most_first:
        f = f.where(F.col("_turn") <= F.col("max_results"))
    return f.select(F.col("question_id").alias("source_id"), text.sha256("url").alias("content_hash"), "title", text.clean("text").alias("extracted_text"), F.lit("").alias("extracted_html"), "url")


BUILT_IN: dict[str, Handler] = {"web": web, "rss": rss, "document": document, "api": api}


def registry(discovered: dict[str, Handler] | None = None) -> dict[str, Handler]:
    """Handlers by type; discovered ones (services whose name ends in _fetch) never replace a built-in one."""
    named = {k.removesuffix("_fetch"): v for k, v in (discovered or {}).items() if k.endswith("_fetch")}
    return named | BUILT_IN


def process(sources: DataFrame, answers: DataFrame, extractions: DataFrame, now: int, handlers: dict[str, Handler] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Work off fetched answers (id, status, body, error): the sources after it, new extractions, and log rows.

    Unknown types are handled as web pages. A failed fetch is classified and repaired; known content is not stored again.
    """
    handlers = handlers or BUILT_IN
    kind = F.when(F.col("source_type").isin(*handlers), F.col("source_type")).otherwise("web")
    jobs = sources.where("enabled").join(answers.select("id", "status", "body", "error"), "id").withColumn("kind", kind).withColumnRenamed("id", "source_id")
    failed = jobs.where(F.col("error").isNotNull())
    good = jobs.where(F.col("error").isNull())
    items, outcomes = [], []
    for name, handle in handlers.items():
        a, b = handle(good.where(F.col("kind") == name))
        items.append(a.select(*ITEM))
        outcomes.append(b.select(*OUTCOME))
    item, outcome = items[0], outcomes[0]
    for a, b in zip(items[1:], outcomes[1:], strict=True):
        item, outcome = item.unionByName(a), outcome.unionByName(b)
    outcome = outcome.unionByName(failed.select("source_id", F.lit("error").alias("status"), "error", F.lit(None).cast("string").alias("body_hash")))
    new = item.withColumn("id", tables.make_id("source_id", "content_hash")).withColumn("extracted_at", F.lit(now))
    new = state.insert_new(extractions, new, "source_id")
    log = outcome.select(tables.make_id("source_id", "status", "body_hash").alias("id"), "source_id", "status", rules.status_code(F.coalesce("error", F.lit(""))).alias("status_code"), F.col("body_hash").alias("content_hash"), F.col("error").alias("error_message"), F.lit(now).alias("fetched_at"))
    s = sources.join(outcome.select(F.col("source_id").alias("id"), F.col("status").alias("_s"), F.col("error").alias("_e"), F.col("body_hash").alias("_h")), "id", "left")
    s = state.fetch_success(s, F.col("_s").isin("ok", "empty"), F.col("_h"), now)
    s = state.fetch_unchanged(s, F.col("_s") == "unchanged", now)
    s = state.fetch_error(s, F.col("_s").isin("error", "extract_error"), F.coalesce("_e", F.lit("")), now)
    s = s.withColumn("last_status", F.when(F.col("_s") == "extract_error", "extract_error").otherwise(F.col("last_status")))
    bad = outcome.where(F.col("status") == "error").select(F.col("source_id").alias("id"), rules.status_code(F.coalesce("error", F.lit(""))).alias("status"), F.coalesce("error", F.lit("")).alias("message"))
    return state.repair(s.select(*sources.columns), bad, now), new, log
