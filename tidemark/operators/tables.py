"""A store of Parquet tables in any file system that Spark writes to.

Rows of tenants share a table, which is partitioned by `dossier_id`; every read of a tenant names one. New rows are
appended as files of their own, whoever else writes at that time; a change of a tenant's rows replaces that partition
when its job is committed, and leaves those of the others alone. Of two changes of one tenant's table at a time, the one
that is committed last holds, so a tenant is changed by one writer. Tables with a text index keep it beside them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import TABLES
from . import aggregates, joins, search, state

TENANT = "dossier_id"
#: Tables with a text index: their key and the columns that are searched.
INDEX_BUCKETS = 16
INDEXED = {"extractions": ("id", ("title", "extracted_text")), "chunks": ("id", ("text",))}


class Store:
    def __init__(self, spark: SparkSession, path: str, dossier: str | None = None):
        self.spark, self.path, self.dossier = spark, path.rstrip("/"), dossier

    def of(self, dossier: str) -> Store:
        """The same store, seen by one tenant."""
        return Store(self.spark, self.path, dossier)

    # -- files

    def _whole(self, name: str) -> DataFrame:
        ddl = f"{TABLES[name]}, {TENANT} string"
        try:  # columns that older files lack are null
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], ddl)

    def read(self, name: str) -> DataFrame:
        df = self._whole(name)
        return df if self.dossier is None else df.where(F.col(TENANT) == self.dossier).drop(TENANT)

    def all_tenants(self, name: str) -> DataFrame:
        return self._whole(name)

    def _drop(self, *parts: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, name: str, df: DataFrame) -> None:
        """df becomes the tenant's rows of a table; without a tenant, the rows of all tenants that it has, and the others have none left."""
        names = [c.split()[0] for c in _columns(name)]
        if self.dossier is not None:
            df = df.withColumn(TENANT, F.lit(self.dossier))
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in [*names, TENANT]))
        before = {self.dossier} if self.dossier is not None else {r[0] for r in self._whole(name).select(TENANT).distinct().collect()}
        after = {r[0] for r in df.select(TENANT).distinct().collect()}  # a row per tenant
        if after:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(TENANT).parquet(f"{self.path}/{name}")
        for gone in before - after:
            self._drop(name, f"{TENANT}={gone}")
        if name in INDEXED:
            for tenant in before | after:
                self._drop(f"{name}_index", f"{TENANT}={tenant}")
                one = self.of(tenant)
                one._add_to_index(name, one.read(name))

    def _rows(self, name: str, rows: list[dict] | DataFrame) -> DataFrame:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([[r.get(c.split()[0]) for c in _columns(name)] for r in rows], TABLES[name])
        kinds = self.spark.createDataFrame([], TABLES[name]).dtypes
        return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds), *([TENANT] if self.dossier is None else []))

    def append(self, name: str, rows: list[dict] | DataFrame) -> None:
        """More rows, as files beside the others; without a tenant, the rows name theirs."""
        df = self._rows(name, rows)
        tagged = df if self.dossier is None else df.withColumn(TENANT, F.lit(self.dossier))
        tagged.write.mode("append").partitionBy(TENANT).parquet(f"{self.path}/{name}")
        if name in INDEXED:
            self._add_to_index(name, df)

    def _add_to_index(self, name: str, df: DataFrame) -> None:
        key, columns = INDEXED[name]
        tenants = [self.dossier] if self.dossier is not None else [r[0] for r in df.select(TENANT).distinct().collect()]
        for t in tenants:
            mine = df if self.dossier is not None else df.where(F.col(TENANT) == t)
            search.index(mine, key, columns, INDEX_BUCKETS).withColumn(TENANT, F.lit(t)).repartition("bucket").write.mode("append").partitionBy(TENANT, "bucket").parquet(f"{self.path}/{name}_index")

    def postings(self, name: str) -> DataFrame:
        """The text index of a table, of all tenants or of one; of a search only the buckets of its terms are read."""
        ddl = f"doc string, column string, term string, positions array<int>, length int, {TENANT} string, bucket int"
        try:
            df = self.spark.read.schema(ddl).parquet(f"{self.path}/{name}_index")
        except AnalysisException:
            df = self.spark.createDataFrame([], ddl)
        return df if self.dossier is None else df.where(F.col(TENANT) == self.dossier)

    def change(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        self.write(name, f(self.read(name)))

    def get(self, name: str, key: str, value: object) -> dict | None:
        """The row with a key, or None."""
        rows = self.read(name).where(F.col(key) == value).limit(1).collect()
        return rows[0].asDict(recursive=True) if rows else None

    def put(self, name: str, rows: DataFrame, key: str = "id", keep: tuple[str, ...] = ()) -> None:
        self.change(name, lambda df: state.upsert(df, rows.select(*df.columns), key, keep))

    def remove(self, name: str, where: Column, children: dict[str, str] | None = None, key: str = "id") -> None:
        """Rows and, in the child tables (name -> foreign key), what points at them."""
        left, kids = state.delete(self.read(name), where, {n: (self.read(n), fk) for n, fk in (children or {}).items()}, key)
        for n, kid in kids.items():
            self.write(n, kid)
        self.write(name, left)

    # -- services

    def add_sources(self, new: DataFrame, now: int) -> DataFrame:
        """Adds valid sources; returns the rejected ones with reasons."""
        cols = self.read("sources").columns
        known = [c for c in cols if c in new.columns]
        rows = new.select(*known, *(F.lit(None).alias(c) for c in cols if c not in known)).select(*cols)
        rows = rows.select(*(F.col(c).cast(t).alias(c) for c, t in self.read("sources").dtypes))
        rows = rows.withColumn("fail_count", F.coalesce("fail_count", F.lit(0))).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
        taken, bad = state.admit_sources(self.read("sources"), rows, now)
        self.append("sources", taken)
        return bad  # of the files as they were before

    def delete_source(self, source_id: str) -> None:
        self.remove("sources", F.col("id") == source_id, {"extractions": "source_id", "fetch_log": "source_id"})

    def add_questions(self, questions: DataFrame, now: int) -> None:
        """Questions, each with the source that stands behind it."""
        cols = [c.split()[0] for c in _columns("tracked_questions")]
        q = state.question_defaults(questions)
        self.append("tracked_questions", q.select(*(c for c in q.columns if c in cols)))
        s = state.question_source(q, now).withColumns({"config_json": F.lit("{}"), "last_status": F.lit("pending"), "fail_count": F.lit(0), "updated_at": F.lit(now)})
        self.append("sources", s)

    def search(self, query: str, now: int, limit: int = 20) -> DataFrame:
        """Extractions that match, best first, by the text index; the search is logged."""
        ranked = search.bm25_index(self.postings("extractions"), query, "id", ("title", "extracted_text"), limit, buckets=INDEX_BUCKETS)
        found = self.read("extractions").select("id", "title", "url").join(F.broadcast(ranked), "id").select("id", "rank", "title", "url").orderBy("rank", "id")  # at most `limit` rows
        self.append("search_log", [{"id": uuid.uuid4().hex, "query": query, "result_count": found.count(), "searched_at": now}])
        return found

    def stats(self) -> DataFrame:
        return aggregates.counts({n: self.read(n) for n in ("sources", "extractions", "fetch_log")})

    def history(self, source_id: str, limit: int = 50) -> DataFrame:
        return self.read("fetch_log").where(F.col("source_id") == source_id).orderBy(F.desc("fetched_at"), "id").limit(limit)

    def overview(self) -> DataFrame:
        """Active tenants with their counts."""
        return aggregates.counts_by_shard(self._whole("shards"), {n: self._whole(n) for n in ("sources", "extractions", "fetch_log")})

    def search_chunks(self, query: str, folders: list[str] | None = None, trust: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        """Chunks that match, with their content and rule; a trust level is met exactly."""
        rules = self.read("extraction_rules").select(F.col("id").alias("rule_id"), "trust_level", "folder_id")
        content = self.read("content_cache").select(F.col("id").alias("content_id"), "rule_id", "page_url", "title")
        c = self.read("chunks").select("id", "content_id").join(content, "content_id").join(rules, "rule_id")
        if folders:
            c = c.where(F.col("folder_id").isin(folders))
        if trust:
            c = c.where(F.col("trust_level") == trust)
        # ranks are those among all chunks, whatever is filtered
        ranked = search.bm25_index(self.postings("chunks"), query, "id", ("text",), None, buckets=INDEX_BUCKETS)
        found = ranked.join(c, "id").select("id", "rank", "content_id", "title", "page_url", "trust_level").orderBy("rank", "id")
        return (found.offset(offset) if offset else found).limit(limit)

    def content(self, content_id: str) -> dict | None:
        """A content with its chunks in order."""
        one = self.read("content_cache").where(F.col("id") == content_id)
        kids = self.read("chunks").where(F.col("content_id") == content_id)
        rows = joins.nest(one, kids, "id", "content_id", "chunk_index", "chunks").collect()
        return rows[0].asDict(recursive=True) if rows else None


def _columns(name: str) -> list[str]:
    depth, out = 0, [""]
    for c in TABLES[name]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def make_id(*parts: str) -> Column:
    """An id from what a row is about, the same whenever it is made again."""
    return F.substring(text.sha256(F.concat_ws("\x1f", *parts)), 1, 32)
