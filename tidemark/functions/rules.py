"""Classification and scoring rules as Column expressions: errors, trust, reputation, costs, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRUST = {"official": 1.3, "institutional": 1.1, "community": 1.0, "unverified": 0.8}
NETWORK = ("timeout", "deadline exceeded", "connection refused", "connection reset", "no such host", "dns", "eof", "tls handshake")
SOURCE_TYPES = ("web", "rss", "api", "document", "question")
SECONDS_A_MONTH = 2_592_000


def _any(message: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | message.contains(w)
    return out


def status_code(message: Column | str) -> Column:
    """HTTP status named in an error message, 0 if none: after 'http ', 'http: ', 'status ' or 'status: ', tried in that order."""
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    found = []
    for prefix in ("http ", "http: ", "status ", "status: "):
        word = F.regexp_extract(m, rf"^(?s:.*?){prefix}\s*([^ ]*)", 1)
        code = F.when(word.rlike(r"^\+?[1-5][0-9]{2}$") & m.contains(prefix), F.regexp_replace(word, r"^\+", "")).try_cast("int")
        found.append(F.when(code.between(100, 599), code))
    return F.coalesce(*found, F.lit(0))


def is_parse_error(message: Column) -> Column:
    return (message.contains("xml") & _any(message, ("parse", "syntax", "unexpected"))) | (message.contains("json") & _any(message, ("unmarshal", "invalid", "unexpected"))) | (message.contains("encoding") & message.contains("invalid"))


def is_network_error(message: Column) -> Column:
    return _any(message, NETWORK)


def classify_error(source_type: Column, status: Column, message: Column) -> Column:
    """Class and action of a failure: first by status, then by the words of the message."""
    m = F.lower(message)
    pair = lambda a, b: F.struct(F.lit(a).alias("error_class"), F.lit(b).alias("action"))
    return (
        F.when(status.isin(301, 302, 307, 308), pair("redirect", "follow_redirect"))
        .when(status == 429, pair("rate_limit", "increase_rate"))
        .when(status == 401, pair("auth", "mark_broken"))
        .when((status == 403) & source_type.isin("web", "rss"), pair("forbidden", "rotate_ua"))
        .when(status == 403, pair("forbidden", "mark_broken"))
        .when(status.isin(404, 410), pair("not_found", "mark_broken"))
        .when(status.between(500, 599), pair("temporary", "backoff"))
        .when(is_parse_error(m), pair("parse", "mark_broken"))
        .when(is_network_error(m), pair("temporary", "backoff"))
        .otherwise(pair("unknown", "none"))
    )


def trust_multiplier(level: Column | str) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    out = F.lit(1.0)
    for name, value in TRUST.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def auto_accept(accepted: Column, rejected: Column) -> Column:
    """At least three accepted corrections and less than a fifth rejected; false without history."""
    total = accepted + rejected
    return F.coalesce((accepted >= 3) & (rejected / F.when(total > 0, total) < 0.2), F.lit(False))


def ema_success(rate: Column) -> Column:
    return F.least(F.lit(1.0), rate * 0.95 + 0.05)


def ema_failure(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), rate * 0.95)


def success_badge(rate: Column) -> Column:
    return F.when(rate < 0.5, "bad").when(rate < 0.8, "warn").otherwise("good")


def ratio_badge(accepted: Column, rejected: Column) -> Column:
    total = accepted + rejected
    ratio = accepted / F.when(total > 0, total)
    return F.when(total == 0, "warn").when(ratio >= 0.8, "good").when(ratio >= 0.5, "warn").otherwise("bad")


def validate_source(name: Column, url: Column, source_type: Column, interval: Column, config: Column) -> Column:
    """Array of what is wrong with a source; empty if it is valid. Lengths are in bytes."""
    size = F.octet_length
    rules = [
        (F.coalesce(size(name), F.lit(0)) == 0, "name required"), (size(name) > 512, "name too long"),
        (F.coalesce(size(url), F.lit(0)) == 0, "url required"), (size(url) > 4096, "url too long"),
        (~F.coalesce(source_type, F.lit("")).isin(*SOURCE_TYPES), "unknown type"),
        (~F.coalesce(interval, F.lit(0)).between(60_000, 604_800_000), "interval out of range"),
        (size(config) > 8192, "config too long"), ((F.coalesce(config, F.lit("")) != "") & F.try_parse_json(config).isNull(), "config is not JSON"),
        ((source_type == "document") & F.coalesce(F.try_url_decode(url), url).contains(".."), "path leaves its folder"),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(said)) for bad, said in rules)), lambda x: x.isNotNull())


def threshold_decision(backlog: Column, unit: Column, per_second: Column, has_dedicated: Column) -> Column:
    """Costs of working off a backlog serverless or on a dedicated machine for a month, and the decision.

    Any active dedicated machine decides for it, so the alert at 80 % of its price never shows.
    """
    serverless = F.coalesce(backlog * unit, F.lit(0.0))
    dedicated = F.coalesce(per_second * SECONDS_A_MONTH, F.lit(0.0))
    return F.struct(serverless.alias("serverless_cost"), dedicated.alias("dedicated_cost"), F.when(F.coalesce(has_dedicated, F.lit(False)), "dedicated").otherwise("serverless").alias("decision"))
