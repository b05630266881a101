"""URL functions: normalisation, validation and GitHub addresses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _sorted_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    plain = lambda x: F.try_url_decode(x)
    named = F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))
    kept = F.array_sort(F.filter(named, lambda p: p["k"].isNotNull() & p["v"].isNotNull()))
    return F.array_join(F.transform(kept, lambda p: F.concat(_escape(p["k"]), F.lit("="), _escape(p["v"]))), "&")


def _escape(c: Column) -> Column:
    # Java leaves * alone and escapes ~
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalise(url: Column | str) -> Column:
    """The normal form of a source URL, or null where it is malformed.

    http and https: scheme and host in lower case, no fragment, no slash at the end of the path, query sorted and
    escaped anew. Other schemes and relative paths stay as they are. Empty text, a text with spaces or a bare word
    without a scheme, and a missing host are malformed.
    """
    u = F.col(url) if isinstance(url, str) else url
    kind, name = scheme(u), host(u)
    bare = kind == ""
    bad = (u == "") | (bare & u.contains(" ")) | (bare & ~u.contains("/") & ~u.contains("."))
    web = kind.isin("http", "https")
    rest = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    path = F.regexp_replace(F.substring_index(rest, "?", 1), "/+$", "")
    query = F.when(rest.contains("?"), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    sorted_query = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), _sorted_query(query)))
    return F.when(bad | (web & (name == "")), F.lit(None)).when(web, F.concat(kind, F.lit("://"), name, path, sorted_query)).otherwise(u)


def template(pattern: Column | str, query: Column | str) -> Column:
    """A search URL template with {query} replaced by the escaped query."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    q = F.col(query) if isinstance(query, str) else query
    return F.replace(p, F.lit("{query}"), _escape(q))


def github(url: Column | str) -> Column:
    """owner, repo and resource of a GitHub address ('' where missing)."""
    u = F.col(url) if isinstance(url, str) else url
    rest = F.split(F.regexp_replace(u, r"^(https?://github\.com/|github\.com/)", ""), "/", 4)
    part = lambda i: F.coalesce(F.get(rest, F.lit(i)), F.lit(""))
    return F.struct(part(0).alias("owner"), part(1).alias("repo"), part(2).alias("resource"))


def github_api(owner: Column, repo: Column, resource: Column, per_page: int = 30, state: str = "open") -> Column:
    base = F.concat(F.lit("https://api.github.com/repos/"), owner, F.lit("/"), repo, F.lit("/"))
    return (
        F.when(resource.isin("issues", "pulls"), F.concat(base, resource, F.lit(f"?state={state}&per_page={per_page}&sort=updated&direction=desc")))
        .when(resource == "releases", F.concat(base, F.lit(f"releases?per_page={per_page}")))
        .otherwise(F.concat(base, F.lit(f"commits?per_page={per_page}")))
    )
