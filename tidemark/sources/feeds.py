"""Feeds, JSON APIs and code-host items: documents with records inside, as tables of records.

Parsing of XML and of JSON of no fixed shape runs in Arrow batches; a document that cannot be read gives a row with an error.
"""

from __future__ import annotations

import json
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

ENTRY = ("guid", "title", "link", "description", "content", "published", "author")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _child(e: ET.Element, name: str) -> str:
    return next(((c.text or "").strip() for c in e if _local(c.tag) == name), "")


def _link(e: ET.Element) -> str:
    """The first alternate link, or one without a relation; else the first one."""
    links = [c for c in e if _local(c.tag) == "link"]
    best = next((c for c in links if c.get("rel", "") in ("", "alternate")), links[0] if links else None)
    return (best.get("href") or "").strip() if best is not None else ""


def detect(data: str) -> str:
    """rss, atom or '' by the first element."""
    m = re.search(r"<\s*(?![!?])(?:[\w.-]+:)?([\w.-]+)", re.sub(r"<!--.*?-->", "", data or "", flags=re.S))
    return {"rss": "rss", "rdf": "rss", "feed": "atom"}.get(m[1].lower() if m else "", "")


def parse_feed(data: str) -> tuple[list[dict], str | None]:
    """Entries of an RSS 2.0 or Atom 1.0 document, and an error. A feed that starts with rdf is taken for RSS, and then fails."""
    if not (data or "").strip():
        return [], "feed: empty"
    kind = detect(data)
    if not kind:
        return [], "feed: unknown format"
    try:
        root = ET.fromstring(data.strip())
    except ET.ParseError as e:
        return [], f"feed: {e}"
    if kind == "rss":
        if _local(root.tag) != "rss":
            return [], f"feed: expected rss, found {_local(root.tag)}"
        channel = next((c for c in root if _local(c.tag) == "channel"), None)
        rows = []
        for item in (c for c in (channel if channel is not None else []) if _local(c.tag) == "item"):
            get = lambda n, item=item: _child(item, n)
            rows.append({"guid": get("guid") or get("link"), "title": get("title"), "link": get("link"), "description": get("description"), "content": get("encoded"), "published": get("pubDate"), "author": get("author") or get("creator")})
        return rows, None
    rows = []
    for entry in (c for c in root if _local(c.tag) == "entry"):
        get = lambda n, entry=entry: _child(entry, n)
        who = next((c for c in entry if _local(c.tag) == "author"), None)
        rows.append({"guid": get("id") or _link(entry), "title": get("title"), "link": _link(entry), "description": get("summary"), "content": get("content"), "published": get("published") or get("updated"), "author": _child(who, "name") if who is not None else ""})
    return rows, None


def _rows(parse, fields: tuple[str, ...]):
    schema = pa.schema([("doc", pa.string()), ("position", pa.int32()), *((f, pa.string()) for f in fields), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error = parse(body)
                if error:
                    out.append({"doc": doc, "position": None, "error": error})
                out += [{"doc": doc, "position": i, **r} for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def read_feeds(docs: DataFrame, body: str = "body", key: str = "doc", most: int | None = None) -> DataFrame:
    """doc, position, the fields of an entry, error of the feeds in docs; most: first entries of each feed only. key is a string."""
    ddl = "doc string, position int, " + ", ".join(f"{f} string" for f in ENTRY) + ", error string"
    out = docs.select(F.col(key).cast("string").alias("doc"), F.col(body).alias("body")).mapInArrow(_rows(parse_feed, ENTRY), ddl)
    return out.where(F.col("position").isNull() | (F.col("position") < most)) if most is not None else out


# -- JSON -------------------------------------------------------------------------------------------------------------


def as_string(v) -> str:
    """'' for null, text as it is; numbers as doubles in their shortest form, with an exponent from a million on (and below 1e-4)."""
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        x = float(v)
        if x == 0:
            return "0"
        short = next(t for n in range(18) if float(t := f"{x:.{n}e}") == x)
        mantissa, exponent = short.split("e")
        if -4 <= int(exponent) < 6:
            return f"{x:.{max(0, len(mantissa.lstrip('-').replace('.', '')) - 1 - int(exponent))}f}"
        return f"{mantissa}e{exponent[0]}{abs(int(exponent)):02d}"
    if isinstance(v, list):
        return "[" + " ".join("<nil>" if x is None else as_string(x) for x in v) + "]"
    return "map[" + " ".join(f"{k}:{'<nil>' if v[k] is None else as_string(v[k])}" for k in sorted(v)) + "]"


def walk(value, path: str):
    """The array at a dotted path of object keys; an empty path needs an array at the root."""
    for part in path.split(".") if path else []:
        if not isinstance(value, dict):
            raise ValueError(f"expected an object at {part}")
        if part not in value:
            raise ValueError(f"key {part} not found")
        value = value[part]
    if not isinstance(value, list):
        raise ValueError(f"{path or 'root'} is not an array")
    return value


_NAMES = ("title", "text", "url")


def _items(data: str, path: str, fields: dict[str, str] | None) -> tuple[list[dict], str | None]:
    wanted = {n: n for n in _NAMES} if fields is None else fields
    try:
        items = walk(json.loads(data or ""), path)
    except ValueError as e:
        return [], str(e)
    return [{n: as_string(x.get(wanted[n])) if n in wanted else "" for n in _NAMES} for x in items if isinstance(x, dict)], None


_ITEM = "doc string, position int, title string, text string, url string, error string"


def read_api(docs: DataFrame, path: str = "", fields: dict[str, str] | None = None, body: str = "body", key: str = "doc") -> DataFrame:
    """doc, position, title, text, url, error of the objects in the array at path; fields maps these names to keys (absent ones are '')."""
    return docs.select(F.col(key).cast("string").alias("doc"), F.col(body).alias("body")).mapInArrow(_rows(lambda data: _items(data, path, fields), _NAMES), _ITEM)


def read_shaped(docs: DataFrame) -> DataFrame:
    """What read_api gives, for documents (doc, body) that each name their path and fields (a map, or null)."""
    schema = pa.schema([("doc", pa.string()), ("position", pa.int32()), *((f, pa.string()) for f in _NAMES), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body, path, fields in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows, error = _items(body, path, None if fields is None else dict(fields))
                out += [{"doc": doc, "error": error}] if error else [{"doc": doc, "position": i, **r} for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select(F.col("doc").cast("string").alias("doc"), "body", "path", "fields").mapInArrow(run, _ITEM)


def api_extractions(items: DataFrame) -> DataFrame:
    """Items as extractions: the hash is taken of url|title before an empty url falls back to the document's."""
    return items.where(F.col("error").isNull()).select("doc", "position", "title", "text", F.when(F.col("url") == "", F.col("doc")).otherwise(F.col("url")).alias("url"), text.item_key("url", "title").alias("content_hash"))


def expand_env(s: str, env: dict[str, str] | None = None) -> str:
    """$NAME and ${NAME} replaced from the environment, '' where unset."""
    names = os.environ if env is None else env
    return re.sub(r"\$(?:\{([^}]*)\}|(\w+))", lambda m: names.get(m[1] or m[2], ""), s)


# -- commits, issues, releases ----------------------------------------------------------------------------------------


def github_items(docs: DataFrame, body: str = "body", key: str = "doc", resource: str = "resource") -> DataFrame:
    """doc, position, item_key, title, text, url, hash, error of the items in the JSON arrays of a code host's API."""

    def parse_one(kind: str, x: dict) -> dict:
        if kind == "commits":
            commit = x.get("commit") or {}
            message = commit.get("message") or ""
            return {"item_key": x.get("sha") or "", "title": message.split("\n", 1)[0], "text": message, "url": x.get("html_url") or ""}
        if kind in ("issues", "pulls"):
            labels = [as_string(n.get("name")) for n in x.get("labels") or []]
            said = [x.get("title") or "", *(["Labels: " + ", ".join(labels)] if labels else []), *([x["body"]] if x.get("body") else [])]
            return {"item_key": as_string(x.get("number")), "title": x.get("title") or "", "text": "\n\n".join(said), "url": x.get("html_url") or ""}
        name = x.get("name") or x.get("tag_name") or ""
        return {"item_key": x.get("tag_name") or as_string(x.get("id")), "title": name, "text": "\n\n".join([f"{name} ({x.get('tag_name') or ''})", *([x["body"]] if x.get("body") else [])]), "url": x.get("html_url") or ""}

    fields = ("item_key", "title", "text", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):

                def parse(_, data=data, kind=kind):
                    try:
                        items = walk(json.loads(data or ""), "")
                    except ValueError as e:
                        return [], str(e)
                    rows = [parse_one(kind or "commits", x) for x in items if isinstance(x, dict)]
                    return [r for r in rows if r["item_key"]], None

                yield from _rows(parse, fields)(iter([pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([data], pa.string())], names=["doc", "body"])]))

    ddl = "doc string, position int, item_key string, title string, text string, url string, error string"
    out = docs.select(F.col(key).cast("string").alias("doc"), F.col(body).alias("body"), F.col(resource).alias("resource")).mapInArrow(run, ddl)
    return out.withColumn("content_hash", text.sha256("item_key"))


def search_requests(queries: DataFrame, engines: DataFrame) -> DataFrame:
    """engine, query, url, error: where each engine (name, strategy, enabled, template) would be asked for each query."""
    both = queries.join(engines, "engine")
    kind = F.col("strategy")
    error: Column = F.when(kind == "generic", "generic search is not available").when(kind != "api", "unknown strategy")
    return both.where("enabled").select("engine", "query", F.when(kind == "api", urls.template(F.col("template"), "query")).alias("url"), error.alias("error"))
