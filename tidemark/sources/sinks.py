"""Sinks: Markdown files with front matter, envelopes of stream records, fan-out, and a page of leaderboards."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text

BATCH = "id string, page_url string, page_id string, seq bigint, records array<struct<op:string,xpath:string,node_type:int,tag:string,name:string,value:string,old_value:string,html:string>>, timestamp bigint, snapshot_ref string"
SNAPSHOT = "id string, page_url string, page_id string, html string, html_hash string, timestamp bigint"


def front_matter() -> Column:
    """Front matter of an extraction (id, source_id, dossier_id, source_url, source_type, title, extracted_at in ms, content_hash)."""
    lines = [F.lit("---\n")]
    for c in ("id", "source_id", "dossier_id", "source_url", "source_type"):
        lines.append(F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit("")), F.lit("\n")))
    when = F.date_format(F.timestamp_millis("extracted_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines += [F.concat(F.lit("title: "), text.yaml_value(F.coalesce("title", F.lit(""))), F.lit("\n")), F.concat(F.lit("extracted_at: "), when, F.lit("\n")), F.concat(F.lit("content_hash: "), F.coalesce("content_hash", F.lit("")), F.lit("\n---\n\n"))]
    return F.concat(*lines)


def markdown_files(extractions: DataFrame) -> DataFrame:
    """name and content of each extraction's file."""
    return extractions.select(F.concat("id", F.lit(".md")).alias("name"), F.concat(front_matter(), F.coalesce("text", F.lit(""))).alias("content"))


def write_markdown(extractions: DataFrame, path: str) -> int:
    """Writes ID.md of each extraction below path and returns how many; a file appears whole or not at all.

    path is in a store that Python opens (local or shared folders, S3, GCS, HDFS with its client library). A task that is
    tried again writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)) if re.match(r"^(file:)?/", path) else fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
        store.create_dir(base, recursive=True)
        for batch in batches:
            size = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data, part = content.encode(), f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, f"{base}/{name}")
                size.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(size, pa.int64())], names=["name", "bytes"])

    return markdown_files(extractions).mapInArrow(run, "name string, bytes long").count()


def envelopes(df: DataFrame, kind: str) -> DataFrame:
    """One line of JSON per row: {type, data}."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))


def read_envelopes(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    parsed = lines.select(F.from_json("value", f"type string, data struct<{_struct(schema)}>").alias("e"))
    return parsed.where(F.col("e.type") == kind).select("e.data.*")


def _struct(ddl: str) -> str:
    depth, out = 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        out += ":" if c == " " and depth == 0 and out.rpartition(",")[2].strip().count(":") == 0 and not out.endswith((",", " ")) else c
    return out


class Router:
    """Sends a table to every sink; all are tried, and the first error is raised at the end."""

    def __init__(self, *sinks: Callable[[DataFrame], None] | None):
        self.sinks = [s for s in sinks if s]

    def send(self, df: DataFrame) -> None:
        first: Exception | None = None
        for sink in self.sinks:
            try:
                sink(df)
            except Exception as e:  # noqa: BLE001  the other sinks still get the table
                first = first or e
        if first:
            raise first


def leaderboard_page(domains: DataFrame, instances: DataFrame, most: int = 100) -> str:
    """HTML of the first `most` rows of both leaderboards, with badges and cards of totals."""
    top = domains.select("*", rules.success_badge(F.col("avg_success_rate")).alias("badge"), text.percent("avg_success_rate").alias("shown")).limit(most).collect()
    total = F.col("corrections_accepted") + F.col("corrections_rejected")
    ratio = F.when(total == 0, "—").otherwise(text.percent(F.col("corrections_accepted") / F.greatest(total, F.lit(1))))
    best = instances.select("*", rules.ratio_badge(F.col("corrections_accepted"), F.col("corrections_rejected")).alias("badge"), ratio.alias("shown"), text.day("last_active").alias("day")).limit(most).collect()
    cell = lambda *xs: "".join(f"<td>{x}</td>" for x in xs)
    badge = lambda r: f'<span class="badge {r.badge}">{escape(r.shown)}</span>'
    rows = "".join(f"<tr>{cell(i, escape(r.domain), r.profile_count, badge(r), r.total_uses, r.total_repairs)}</tr>" for i, r in enumerate(top, 1))
    more = "".join(f"<tr>{cell(i, escape(r.instance_id), r.corrections_accepted, r.corrections_rejected, badge(r), r.day)}</tr>" for i, r in enumerate(best, 1))
    cards = f'<div class="cards"><div>{len(top)} domains</div><div>{len(best)} instances</div></div>'
    return f"<!DOCTYPE html><html><head><title>Leaderboard</title></head><body>{cards}<table>{rows}</table><table>{more}</table></body></html>"
