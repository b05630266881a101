"""Seed tables: curated sources by category, and search engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category, name, URL, type, interval in milliseconds (0: the default of an hour), configuration.
SOURCES = [
    ("tech", "Hacker News", "https://hnrss.org/frontpage", "rss", 1_800_000, ""),
    ("tech", "Lobsters", "https://lobste.rs/rss", "rss", 1_800_000, ""),
    ("tech", "Ars Technica", "https://feeds.arstechnica.com/arstechnica/index", "rss", 0, ""),
    ("tech", "The Verge", "https://www.theverge.com/rss/index.xml", "rss", 0, ""),
    ("tech", "TechCrunch", "https://techcrunch.com/feed/", "rss", 0, ""),
    ("tech", "Go Blog", "https://go.dev/blog/feed.atom", "rss", 86_400_000, ""),
    ("legal-fr", "Legifrance JORF", "https://www.legifrance.gouv.fr/rss/jo", "rss", 0, ""),
    ("legal-fr", "CNIL Actualites", "https://www.cnil.fr/fr/rss.xml", "rss", 0, ""),
    ("legal-fr", "EUR-Lex Recent", "https://eur-lex.europa.eu/rss/cli-recent-acts.xml", "rss", 86_400_000, ""),
    ("opendata", "data.gouv.fr Datasets", "https://www.data.gouv.fr/api/1/datasets/?sort=-created&page_size=20", "api", 86_400_000, '{"result_path":"data","fields":{"title":"title","text":"description","url":"page"}}'),
    ("opendata", "OpenAlex Works", "https://api.openalex.org/works?sort=publication_date:desc&per_page=20", "api", 86_400_000, '{"result_path":"results","fields":{"title":"title","text":"abstract_inverted_index","url":"id"}}'),
    ("academic", "arXiv CS.AI", "https://rss.arxiv.org/rss/cs.AI", "rss", 86_400_000, ""),
    ("academic", "arXiv CS.CL", "https://rss.arxiv.org/rss/cs.CL", "rss", 86_400_000, ""),
    ("news-fr", "Le Monde Pixels", "https://www.lemonde.fr/pixels/rss_full.xml", "rss", 0, ""),
    ("news-fr", "Next INpact", "https://www.nextinpact.com/rss/news.xml", "rss", 0, ""),
]
#: Id, name, strategy, URL template, configuration of the API, selectors, stealth level, milliseconds between requests, pages, enabled.
ENGINES = [
    ("brave_api", "Brave Search", "api", "https://api.search.brave.com/res/v1/web/search?q={query}&count=20", '{"headers":{"Accept":"application/json","Accept-Encoding":"gzip","X-Subscription-Token":"${BRAVE_API_KEY}"},"result_path":"web.results","fields":{"title":"title","text":"description","url":"url"}}', "", 0, 1000, 1, True),
    ("ddg_html", "DuckDuckGo HTML", "generic", "https://html.duckduckgo.com/html/?q={query}", "", '{"result_item":".result","title":".result__a","link":".result__a","snippet":".result__snippet"}', 2, 3000, 3, False),
    ("github_search", "GitHub Search", "api", "https://api.github.com/search/repositories?q={query}&sort=updated&per_page=20", '{"headers":{"Accept":"application/vnd.github+json","Authorization":"Bearer ${GITHUB_TOKEN}"},"result_path":"items","fields":{"title":"full_name","text":"description","url":"html_url"}}', "", 0, 2000, 1, True),
    ("scholar", "Google Scholar", "generic", "https://scholar.google.com/scholar?q={query}", "", '{"result_item":".gs_r","title":".gs_rt a","link":".gs_rt a","snippet":".gs_rs"}', 3, 5000, 2, False),
]


def categories(spark: SparkSession) -> DataFrame:
    return sources(spark).select("category").distinct()


def sources(spark: SparkSession, category: str | None = None) -> DataFrame:
    """Curated sources as rows to add: with the default interval and an empty configuration where none is given."""
    df = spark.createDataFrame(SOURCES, "category string, name string, url string, source_type string, fetch_interval long, config_json string")
    df = df.withColumn("fetch_interval", F.when(F.col("fetch_interval") == 0, 3_600_000).otherwise(F.col("fetch_interval"))).withColumn("config_json", F.when(F.col("config_json") == "", "{}").otherwise(F.col("config_json"))).withColumn("enabled", F.lit(True))
    return df if category is None else df.where(F.col("category") == category)


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGINES, "id string, name string, strategy string, url_template string, api_config string, selectors string, stealth_level int, rate_limit_ms long, max_pages int, enabled boolean")


def populate(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with the new rows whose key it does not have."""
    fresh = new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return stored.unionByName(fresh.select(*(c for c in new.columns if c in stored.columns)), allowMissingColumns=True)
