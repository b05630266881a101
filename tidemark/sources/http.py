"""Live HTTP: conditional fetches, probes, APIs, embeddings and webhooks, run by the executors over tables of requests.

Requests are rows; each task works off its own, so the number of partitions bounds how many run at once.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from . import feeds

MOST_BYTES, TIMEOUT, REDIRECTS = 10 << 20, 30, 5


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, allowed: Callable[[str], bool] | None):
        self.allowed = allowed
        self.max_redirections = REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if self.allowed and not self.allowed(newurl):
            raise urllib.error.URLError(f"redirect to {newurl} is not allowed")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def call(url: str, method: str = "GET", headers: dict[str, str] | None = None, body: bytes | None = None, timeout: float = TIMEOUT, allowed: Callable[[str], bool] | None = None) -> tuple[int, bytes, dict[str, str], str | None]:
    """Status (0 without an answer), at most MOST_BYTES of the body, headers in lower case, and an error."""
    if allowed and not allowed(url):
        return 0, b"", {}, "url is not allowed"
    try:
        opener = urllib.request.build_opener(_Redirects(allowed))
        with opener.open(urllib.request.Request(url, data=body, headers=headers or {}, method=method), timeout=timeout) as r:
            return r.status, r.read(MOST_BYTES), {k.lower(): v for k, v in r.headers.items()}, None
    except urllib.error.HTTPError as e:
        return e.code, e.read(MOST_BYTES), {k.lower(): v for k, v in e.headers.items()}, None
    except (urllib.error.URLError, http.client.HTTPException, OSError, ValueError) as e:
        return 0, b"", {}, str(e)


def fetch(url: str, etag: str = "", last_modified: str = "", previous: str = "", allowed: Callable[[str], bool] | None = None) -> dict:
    """status, body, hash, etag, last_modified, changed, error. 304 and the previous hash are no change; other statuses outside 200 to 399 are errors."""
    headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}
    status, body, got, error = call(url, headers=headers, allowed=allowed)
    row = {"status": status, "body": None, "hash": None, "etag": got.get("etag", ""), "last_modified": got.get("last-modified", ""), "changed": False, "error": error}
    if error or status == 304:
        return row
    if not 200 <= status < 400:
        return row | {"error": f"http {status}"}
    digest = hashlib.sha256(body).hexdigest()
    return row | {"body": body.decode(errors="replace"), "hash": digest, "changed": not previous or previous != digest}


_FETCHED = "id string, status int, body string, hash string, etag string, last_modified string, changed boolean, error string, duration_ms long"


def fetch_sources(sources: DataFrame, partitions: int | None = None, allowed: Callable[[str], bool] | None = None) -> DataFrame:
    """Answers for sources (id, url, last_hash)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for r in df.itertuples():
                began = time.monotonic()
                rows.append({"id": r.id, **fetch(r.url, previous=r.last_hash or "", allowed=allowed), "duration_ms": int((time.monotonic() - began) * 1000)})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FETCHED.split(", ")], dtype=object)

    s = sources.select("id", "url", "last_hash")
    return (s.repartition(partitions, "id") if partitions else s).mapInPandas(run, _FETCHED)


def snapshots(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url) as snapshots, whatever the status, with whether they can be read without running them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for r in df.itertuples():
                _, body, got, error = call(r.url)
                html = body.decode(errors="replace")
                rows.append((r.page_id, r.url, html, hashlib.sha256(body).hexdigest(), dom.sufficient(html), got.get("etag", ""), got.get("last-modified", ""), error))
            yield pd.DataFrame(rows, columns=["page_id", "url", "html", "html_hash", "sufficient", "etag", "last_modified", "error"], dtype=object)

    return pages.select("page_id", "url").mapInPandas(run, "page_id string, url string, html string, html_hash string, sufficient boolean, etag string, last_modified string, error string")


def probe(sources: DataFrame, timeout: float = 10) -> DataFrame:
    """id, status_code (0 without an answer), etag, last_modified of a HEAD request each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [(r.id, *call(r.url, "HEAD", timeout=timeout)) for r in df.itertuples()]
            yield pd.DataFrame([(g[0], g[1], g[3].get("etag", ""), g[3].get("last-modified", "")) for g in got], columns=["id", "status_code", "etag", "last_modified"], dtype=object)

    return sources.select("id", "url").mapInPandas(run, "id string, status_code int, etag string, last_modified string")


def call_apis(requests: DataFrame) -> DataFrame:
    """doc, body, error of requests (doc, url, method, headers: map); headers may name environment variables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for r in df.itertuples():
                headers = {"Accept": "application/json"} | {k: feeds.expand_env(v) for k, v in dict(r.headers or {}).items()}
                status, body, _, error = call(r.url, r.method or "GET", headers)
                error = error or (None if 200 <= status < 400 else f"http {status}")
                rows.append((r.doc, None if error else body.decode(errors="replace"), error))
            yield pd.DataFrame(rows, columns=["doc", "body", "error"], dtype=object)

    return requests.select("doc", "url", "method", "headers").mapInPandas(run, "doc string, body string, error string")


def embed(texts: DataFrame, url: str, model: str = "", batch: int = 32, column: str = "text") -> DataFrame:
    """texts with embedding and error: one request for each `batch` texts, answers put in order by their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            said = [t or "" for t in rows.column(column).to_pylist()]
            vectors: list = [None] * len(said)
            errors: list = [None] * len(said)
            for i in range(0, len(said), batch):
                part = said[i : i + batch]
                status, body, _, error = call(url, "POST", {"Content-Type": "application/json"}, json.dumps({"model": model, "input": part}).encode())
                if not error and 200 <= status < 300:
                    for x in json.loads(body).get("data", []):
                        if 0 <= x.get("index", -1) < len(part):
                            vectors[i + x["index"]] = [float(v) for v in x["embedding"]]
                for j in range(len(part)):
                    if vectors[i + j] is None:
                        errors[i + j] = error or (f"http {status}" if not 200 <= status < 300 else "no embedding in the answer")
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*rows.schema.names, "embedding", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{kinds}, embedding array<float>, error string")


def webhook(url: str, kind: str, retries: int = 3, wait: float = 1.0) -> Callable[[DataFrame], None]:
    """A sink that posts each row's envelope, trying again after 1, 2, 4 ... times `wait` seconds; fails if a row is never taken."""
    from .sinks import envelopes

    def send(df: DataFrame) -> None:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in frames:
                bad = []
                for value in part["value"]:
                    for i in range(retries + 1):
                        status, _, _, error = call(url, "POST", {"Content-Type": "application/json"}, value.encode())
                        if 200 <= status < 300:
                            break
                        if i == retries:
                            bad.append(error or f"http {status}")
                        else:
                            time.sleep(wait * 2**i)
                yield pd.DataFrame({"error": bad}, dtype=object)

        first = envelopes(df, kind).mapInPandas(run, "error string").agg(F.first("error").alias("e"), F.count("*").alias("n")).first()
        if first.n:
            raise OSError(f"{first.n} rows were not taken: {first.e}")

    return send
