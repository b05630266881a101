"""Named services over a store: JSON in, JSON out, for a router of any transport to call."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..sources import files, http
from . import aggregates, handlers, search, state, vectors
from .tables import INDEX_BUCKETS, Store


class NotFound(KeyError):
    pass


def _rows(df: DataFrame, most: int | None = None) -> list[dict]:
    """Rows of an answer: the first `most` of a list that has a limit, else all."""
    return [r.asDict(recursive=True) for r in (df if most is None else df.limit(most)).toLocalIterator()]


class Services:
    """Services by name. Lists hold at most `limit` rows (50 by default); counts, tiers and the overview are whole."""

    def __init__(self, store: Store, clock: Callable[[], int]):
        self.store, self.clock = store, clock
        self.names = {n.removeprefix("do_"): getattr(self, n) for n in dir(self) if n.startswith("do_")}

    def call(self, name: str, payload: str = "{}") -> str:
        if name not in self.names:
            raise NotFound(name)
        return json.dumps(self.names[name](**json.loads(payload or "{}")), default=str)

    def _of(self, dossier_id: str | None) -> Store:
        return self.store.of(dossier_id) if dossier_id else self.store

    # sources and questions

    def do_add_source(self, name: str, url: str, source_type: str = "web", interval: int = 0, dossier_id: str | None = None) -> dict:
        """Sources added here are enabled and have no configuration."""
        s = self._of(dossier_id)
        new = s.spark.createDataFrame([(name, url, source_type, interval, "", True)], "name string, url string, source_type string, fetch_interval long, config_json string, enabled boolean").withColumn("id", F.substring(F.sha2("url", 256), 1, 32))
        bad = _rows(s.add_sources(new, self.clock()))
        return {"errors": bad[0]["errors"]} if bad else {"id": new.first().id}

    def do_update_source(self, id: str, dossier_id: str | None = None, enabled: bool = False, config_json: str = "", **changes) -> dict:  # noqa: A002
        """What is left out of name, url, type and interval stays; enabled and the configuration are set even then."""
        s = self._of(dossier_id)
        row = [(id, changes.get("name", ""), changes.get("url", ""), changes.get("source_type", ""), changes.get("interval", 0), enabled, config_json)]
        c = s.spark.createDataFrame(row, "id string, name string, url string, source_type string, fetch_interval long, enabled boolean, config_json string")
        s.change("sources", lambda df: state.merge_source(df, c, self.clock()))
        return s.get("sources", "id", id) or {}

    def do_delete_source(self, id: str, dossier_id: str | None = None) -> dict:  # noqa: A002
        self._of(dossier_id).delete_source(id)
        return {"deleted": id}

    def do_list_sources(self, dossier_id: str | None = None, limit: int = 50) -> list[dict]:
        return _rows(self._of(dossier_id).read("sources").orderBy(F.desc("created_at"), "id"), limit)

    def do_reset_source(self, id: str, dossier_id: str | None = None) -> dict:  # noqa: A002
        self._of(dossier_id).change("sources", lambda df: state.reset(df, F.col("id") == id, self.clock()))
        return {"reset": id}

    def do_add_question(self, text: str, channels: list[str] | None = None, schedule_ms: int | None = None, dossier_id: str | None = None) -> dict:
        s = self._of(dossier_id)
        q = s.spark.createDataFrame([(text, text, json.dumps(channels or []), schedule_ms, None, True)], "text string, keywords string, channels string, schedule_ms long, max_results int, enabled boolean").withColumn("id", F.substring(F.sha2("text", 256), 1, 32))
        s.add_questions(q, self.clock())
        return {"id": q.first().id}

    def do_list_questions(self, dossier_id: str | None = None, limit: int = 50) -> list[dict]:
        return _rows(self._of(dossier_id).read("tracked_questions").orderBy(F.desc("created_at"), "id"), limit)

    def do_question_results(self, id: str, dossier_id: str | None = None, limit: int = 50) -> list[dict]:  # noqa: A002
        """The extractions of the source that stands behind the question."""
        return _rows(self._of(dossier_id).read("extractions").where(F.col("source_id") == id).orderBy(F.desc("extracted_at"), "id"), limit)

    # reading

    def do_search(self, query: str, dossier_id: str | None = None, limit: int = 20) -> list[dict]:
        return _rows(self._of(dossier_id).search(query, self.clock(), limit), limit)

    def do_search_chunks(self, query: str, folder_ids: list[str] | None = None, trust_level: str | None = None, limit: int = 20, offset: int = 0, dossier_id: str | None = None) -> list[dict]:
        return _rows(self._of(dossier_id).search_chunks(query, folder_ids, trust_level, limit, offset), limit)

    def do_tiered_search(self, query: str, tier: str = "free", max_passes: int = 0, limit: int = 20, user_id: str = "", dossier_id: str | None = None) -> list[dict]:
        s, began = self._of(dossier_id), self.clock()
        content = s.read("content_cache").select(F.col("id").alias("content_id"), "rule_id").join(s.read("extraction_rules").select(F.col("id").alias("rule_id"), "trust_level"), "rule_id")
        found = _rows(search.tiered(s.read("chunks").join(content, "content_id"), query, "id", ("text",), tier, max_passes, limit, "trust_level", s.postings("chunks"), INDEX_BUCKETS), limit)
        s.append("search_tiers", [{"id": f"{began}-{query}", "user_id": user_id, "tier": tier, "query": query, "passes": max((r["pass"] for r in found), default=1), "results_count": len(found), "latency_ms": self.clock() - began, "created_at": began}])
        return found

    def do_tier_stats(self, dossier_id: str | None = None) -> list[dict]:
        return _rows(aggregates.tier_stats(self._of(dossier_id).read("search_tiers")))

    def do_stats(self, dossier_id: str | None = None) -> list[dict]:
        return _rows(self._of(dossier_id).stats())

    def do_history(self, source_id: str, limit: int = 50, dossier_id: str | None = None) -> list[dict]:
        return _rows(self._of(dossier_id).history(source_id, limit), limit)

    def do_overview(self, after: str = "", limit: int | None = None) -> list[dict]:
        """Active tenants by id, all of them or a page after one."""
        return _rows(self.store.overview().where(F.col("dossier_id") > after).orderBy("dossier_id"), limit)

    # rules, costs, sweeps, failures

    def do_add_rule(self, name: str, url_pattern: str = "", page_id: str = "", selectors: list[str] | None = None, extract_mode: str = "auto", trust_level: str = "unverified", folder_id: str = "", priority: int = 0, dossier_id: str | None = None) -> dict:
        now = self.clock()
        rule = {"id": uuid.uuid4().hex, "name": name, "url_pattern": url_pattern, "page_id": page_id, "selectors": selectors or [], "extract_mode": extract_mode or "auto", "trust_level": trust_level or "unverified", "folder_id": folder_id, "enabled": True, "priority": priority, "version": 1, "fail_count": 0, "created_at": now, "updated_at": now}
        self._of(dossier_id).append("extraction_rules", [rule])
        return rule

    def do_list_rules(self, enabled_only: bool = False, limit: int = 50, dossier_id: str | None = None) -> list[dict]:
        r = self._of(dossier_id).read("extraction_rules")
        return _rows((r.where("enabled") if enabled_only else r).orderBy(F.desc("priority"), "created_at", "id"), limit)

    def do_cost(self, backlog: float = 0, dossier_id: str | None = None) -> dict:
        """Active prices, and what a backlog costs either way."""
        p = self._of(dossier_id).read("gpu_pricing")
        return {"pricing": _rows(p.where("status = 'active'").orderBy("cost_per_unit", "id")), "threshold": aggregates.cost_decision(p, float(backlog)).first().asDict()}

    def do_sweep(self, probes: list[dict] | None = None, dossier_id: str | None = None) -> dict:
        """Broken sources that answer again are reset; probes (id, status_code) stand in for asking them."""
        s = self._of(dossier_id)
        broken = s.read("sources").transform(state.broken_sources)
        told = http.probe(broken) if probes is None else s.spark.createDataFrame([(p["id"], p["status_code"]) for p in probes], "id string, status_code int")
        told = s.spark.createDataFrame(told.select("id", "status_code").collect(), "id string, status_code int")  # asked once; a row per broken source
        after, summary = state.sweep(s.read("sources"), told, self.clock())
        out = summary.first().asDict()
        s.write("sources", after)
        return out

    def do_report_failure(self, profile_id: str, instance_id: str = "", error_type: str = "", message: str = "", dossier_id: str | None = None) -> dict:
        s, now = self._of(dossier_id), self.clock()
        if s.get("profiles", "id", profile_id) is None:
            raise NotFound(profile_id)
        s.append("reports", [{"id": uuid.uuid4().hex, "profile_id": profile_id, "instance_id": instance_id, "error_type": error_type, "message": message, "created_at": now}])
        s.change("profiles", lambda df: state.report_failure(df, F.col("id") == profile_id))
        return s.get("profiles", "id", profile_id)

    def do_fetch_now(self, id: str, answer: dict | None = None, dossier_id: str | None = None) -> dict:  # noqa: A002
        """Works off one source at once; answer (status, body, error) stands in for asking it."""
        s = self._of(dossier_id)
        one = s.read("sources").where(F.col("id") == id)
        if not one.take(1):
            raise NotFound(id)
        told = http.fetch_sources(one).select("id", "status", "body", "error").collect() if answer is None else [(id, answer.get("status", 200), answer.get("body"), answer.get("error"))]
        answers = s.spark.createDataFrame(told, "id string, status int, body string, error string")
        after, new, log = handlers.process(one, answers, s.read("extractions"), self.clock(), handlers.registry())
        rows = [r.asDict(recursive=True) for r in new.collect()]  # of one source
        s.append("fetch_log", [r.asDict() for r in log.collect()])
        changed = after.collect()
        s.put("sources", s.spark.createDataFrame(changed, after.schema))
        if rows:
            s.append("extractions", rows)
        return {"extracted": len(rows), "status": changed[0].last_status}

    # registry

    def do_publish_profile(self, dossier_id: str | None = None, **profile) -> dict:
        s = self._of(dossier_id)
        names = s.read("profiles").columns
        row = {c: None for c in names} | {"success_rate": 1.0, "total_uses": 0, "total_repairs": 0, "contributors": [], "created_at": self.clock(), "updated_at": self.clock()} | {k: v for k, v in profile.items() if k in names}
        row["id"] = row["id"] or row["url_pattern"]
        s.change("profiles", lambda df: state.publish_profiles(df, s.spark.createDataFrame([[row[c] for c in names]], df.schema)))
        return s.get("profiles", "url_pattern", row["url_pattern"]) or {}

    def do_get_profile(self, key: str, dossier_id: str | None = None) -> dict:
        """By id, else by URL pattern."""
        s = self._of(dossier_id)
        got = s.get("profiles", "id", key) or s.get("profiles", "url_pattern", key)
        if got is None:
            raise NotFound(key)
        return got

    def do_search_profiles(self, domain: str = "", trust_level: str = "", limit: int = 50, dossier_id: str | None = None) -> list[dict]:
        p = self._of(dossier_id).read("profiles")
        p = p.where(F.col("domain") == domain) if domain else p.where(F.col("trust_level") == trust_level) if trust_level else p
        return _rows(p.orderBy(F.desc("success_rate"), F.desc("total_uses"), "id"), limit)

    def do_submit_correction(self, profile_id: str, instance_id: str, new_extractors: str, reason: str = "", dossier_id: str | None = None) -> dict:
        """Accepted at once where the instance's history earns it."""
        s, now = self._of(dossier_id), self.clock()
        cid = f"{profile_id}-{instance_id}-{now}"
        new = s.spark.createDataFrame([(cid, profile_id, instance_id, "", new_extractors, reason, 0, now)], s.read("corrections").schema)
        judged = state.submit_corrections(s.read("corrections").limit(0), new) if not s.read("corrections").limit(1).count() else state.submit_corrections(s.read("corrections"), new)
        accepted = judged.where((F.col("id") == cid) & (F.col("validated") == 1)).count() > 0
        s.write("corrections", judged.withColumn("validated", F.when(F.col("id") == cid, 0).otherwise(F.col("validated"))))
        if accepted:
            self.do_accept_correction(cid, dossier_id)
        return {"id": cid, "accepted": accepted}

    def do_accept_correction(self, id: str, dossier_id: str | None = None) -> dict:  # noqa: A002
        return self._decide(id, True, dossier_id)

    def do_reject_correction(self, id: str, dossier_id: str | None = None) -> dict:  # noqa: A002
        return self._decide(id, False, dossier_id)

    def _decide(self, cid: str, yes: bool, dossier_id: str | None) -> dict:
        s = self._of(dossier_id)
        one, none = s.spark.createDataFrame([(cid,)], "id string"), s.spark.createDataFrame([], "id string")
        corrections, profiles = state.decide(s.read("corrections"), s.read("profiles"), one if yes else none, none if yes else one)
        s.write("profiles", profiles)
        s.write("corrections", corrections)
        return s.get("corrections", "id", cid) or {}

    def do_leaderboard(self, type: str = "domain", limit: int = 50, dossier_id: str | None = None) -> list[dict]:  # noqa: A002
        s = self._of(dossier_id)
        if type == "instance":
            return _rows(aggregates.instance_leaderboard(state.reputation(s.read("corrections")), limit), limit)
        return _rows(aggregates.domain_leaderboard(s.read("profiles"), limit), limit)

    # vectors and documents

    def do_vector_search(self, vector: list[float], top_k: int = 10, ef_search: int = 0, dossier_id: str | None = None) -> list[dict]:
        """ef_search is taken and not needed: the search is exact."""
        return _rows(vectors.nearest(self._of(dossier_id).read("vectors"), vector, top_k, "ext_id", "vector"), top_k)

    def do_vector_insert(self, rows: list[dict], dossier_id: str | None = None) -> dict:
        s = self._of(dossier_id)
        s.append("vectors", [{"ext_id": r["id"], "vector": [float(x) for x in r["vector"]]} for r in rows])
        return {"inserted": len(rows), "count": s.read("vectors").count()}

    def do_vector_stats(self, dossier_id: str | None = None) -> list[dict]:
        return _rows(vectors.index_stats(self._of(dossier_id).read("vectors"), "vector"))

    def do_extract_html(self, html: str, mode: str = "auto", selectors: list[str] | None = None) -> dict:
        return dom.extract(html, mode, selectors)

    def do_embed(self, texts: list[str], url: str = "", model: str = "") -> list[list[float]]:
        """Vectors of texts in their order, by the service at url, or zeros without one."""
        spark = self.store.spark
        df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
        out = http.embed(df, url, model) if url else vectors.zero_embedder(df)
        return [list(r.embedding) for r in out.orderBy("n").collect()]  # as many as were sent

    def do_extract_document(self, name: str, content: str) -> dict:
        """Title, sections and text of a file, whose bytes come as base64."""
        spark = self.store.spark
        one = spark.createDataFrame([(name, bytearray(base64.b64decode(content)))], "path string, content binary")
        return files.read_documents(one).first().asDict(recursive=True)

    def do_detect_format(self, name: str) -> dict:
        return {"format": files.FORMATS.get(name.rpartition(".")[2].lower() if "." in name else "")}

    def do_formats(self) -> list[str]:
        return sorted(set(files.FORMATS.values()))
