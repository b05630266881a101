"""Joins beyond equality of keys: URL patterns, intervals between two sources, look-up chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .shared import new_folder


#: Rules of no fixed host that are broadcast to the pages, and the length of the pieces by which more of them meet pages.
MOST_BROADCAST, GRAM = 10_000, 4
#: Rows of either side in a square of pairs, and most partitions that squares are dealt to.
SIDE, MOST_PARTS = 2048, 10_000


def glob_prefix(pattern: Column) -> Column:
    """What stands in a GLOB pattern before its first wildcard."""
    return F.regexp_extract(pattern, r"^([^*?\[]*)", 1)


def _grams(c: Column) -> Column:
    """Distinct pieces of GRAM characters of each string in an array."""
    of = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - GRAM + 1), lambda i: F.substring(s, i, F.lit(GRAM)))
    return F.array_distinct(F.flatten(F.transform(F.filter(c, lambda s: F.length(s) >= GRAM), of)))


def literals(pattern: Column) -> Column:
    """What a GLOB pattern requires as it stands: its runs without wildcards and classes. Of an open class, what is before it."""
    return F.split(F.regexp_replace(pattern, r"\[\^?.[^\]]*\]|\[.*$", "*"), r"[*?]+")


def by_rarest_piece(pages: DataFrame, rules: DataFrame, url: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of pages and rules that have the rule's rarest piece in common, to be verified; and the rules without a piece.

    A rule matches only URLs with all of its pieces, so it needs to meet those with one of them. Pieces that only pages have
    are dropped before they are counted; a rule with a piece that no page has meets none.
    """
    r = rules.withColumn("_id", F.monotonically_increasing_id()).withColumn("_pieces", _grams(literals(F.col(pattern))))
    each = r.where(F.size("_pieces") > 0).select("_id", F.explode("_pieces").alias("_piece"))
    has = pages.withColumn("_piece", F.explode(_grams(F.array(F.coalesce(F.col(url), F.lit("")))))).join(each.select("_piece").distinct(), "_piece", "left_semi")
    count = each.join(has.groupBy("_piece").agg(F.count("*").alias("n")), "_piece", "left")
    best = count.groupBy("_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_piece")).alias("b")).where("b.n > 0").select("_id", F.col("b._piece").alias("_piece"))
    return has.join(r.join(best, "_id"), "_piece").drop("_piece", "_pieces", "_id"), r.where(F.size("_pieces") <= 0).drop("_pieces", "_id")


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """pages with the rules that apply: by page where a rule names one, else by GLOB of the URL; one row per pair, with rule columns prefixed r_.

    Patterns whose scheme and host hold no wildcard meet pages by these (adaptive execution splits hosts with many pages),
    and then by their fixed start. At most most_broadcast others are broadcast and tried against every page; more of them
    meet the pages that have their rarest piece of GRAM characters. Patterns without so long a piece match by wildcards
    almost alone, and are tried against every page.
    """
    r = rules.where("enabled").select(*(F.col(c).alias(f"r_{c}") for c in rules.columns))
    by_page = pages.join(r.where(F.coalesce("r_page_id", F.lit("")) != ""), F.col(page_id).cast("string") == F.col("r_page_id"))
    r = r.where(F.coalesce("r_page_id", F.lit("")) == "").withColumn("_regex", text.glob_to_regex("r_url_pattern")).withColumn("_fixed", glob_prefix(F.col("r_url_pattern")))
    origin = lambda c: F.regexp_extract(c, r"^([^/?#]*://[^/?#]*)[/?#]", 1)
    r = r.withColumn("_origin", origin(F.col("_fixed")))
    hit = F.col(url).startswith(F.col("_fixed")) & F.regexp_like(F.col(url), F.col("_regex"))
    near = pages.withColumn("_origin", origin(F.col(url))).join(r.where("_origin <> ''"), "_origin").where(hit)
    every = r.where("_origin = ''")
    # of rules with one pattern, one is matched, and what it matches meets them all
    wild = every.select("r_url_pattern").distinct().withColumn("_regex", text.glob_to_regex("r_url_pattern")).withColumn("_fixed", glob_prefix(F.col("r_url_pattern")))
    cols = [*pages.columns, *(f"r_{c}" for c in rules.columns)]
    out = by_page.select(*cols).unionByName(near.select(*cols))
    if every.limit(most_broadcast + 1).count() <= most_broadcast:
        return out.unionByName(pages.join(F.broadcast(every), hit).select(*cols))
    found, bare = by_rarest_piece(pages, wild, url, "r_url_pattern")
    found = found.where(hit).select(*pages.columns, "r_url_pattern")
    n = bare.limit(most_broadcast + 1).count()
    if n:
        found = found.unionByName(pages.join(F.broadcast(bare) if n <= most_broadcast else bare, hit).select(*pages.columns, "r_url_pattern"))
    return out.unionByName(_spread(found, every.select(*(f"r_{c}" for c in rules.columns)), "r_url_pattern").select(*cols))


def _spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined by a key of which both have many rows: its pairs are dealt in squares of SIDE rows of each, to as many partitions as they need.

    left is written to the shared folder, for it is counted first. Rows go by a hash of their columns; each is copied once
    for every square in its line.
    """
    spark = left.sparkSession
    path = new_folder(spark, "matches")
    left.write.parquet(path)
    left = spark.read.schema(left.schema).parquet(path)
    counts = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    counts = counts.select(key, *(F.ceil(F.col(c) / SIDE).cast("int").alias(c) for c in ("_l", "_r")))
    squares = counts.agg(F.sum(F.col("_l") * F.col("_r").cast("long"))).first()[0] or 0
    plain = lambda df: [c for c, kind in df.dtypes if "map<" not in kind]
    at = lambda df, own, other: df.join(counts, key).withColumn(own, F.pmod(F.xxhash64(*plain(df)), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    # a number of partitions that is named is not coalesced: what goes in is small, and what comes out is not
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(squares, MOST_PARTS))
    a, b = (x.repartition(parts, key, "_l", "_r") for x in (at(left, "_l", "_r"), at(right, "_r", "_l")))
    return a.join(b.hint("shuffle_hash"), [key, "_l", "_r"]).drop("_l", "_r")


def best_rule(matches: DataFrame, key: str = "page_id") -> DataFrame:
    """The rule of the highest priority per page."""
    w = Window.partitionBy(key).orderBy(F.desc("r_priority"), "r_id")
    return matches.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def drop_echoes(records: DataFrame, keys: tuple[str, ...], time: str, source: str, weak: str, strong: str, within: int = 50) -> DataFrame:
    """records without those of the weak source that a record of the strong one with the same keys comes close before.

    The order decides: a weak record that came first stays, and so does the strong one after it.
    """
    w = Window.partitionBy(*keys).orderBy(time, F.when(F.col(source) == strong, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(source) == strong, F.col(time)), ignorenulls=True).over(w)
    return records.withColumn("_last", last).where((F.col(source) != weak) | F.col("_last").isNull() | (F.col(time) - F.col("_last") > within)).drop("_last")


def channels_to_engines(questions: DataFrame, engines: DataFrame) -> DataFrame:
    """question_id, position, engine_id, name of each enabled engine in a question's JSON list of channels, in its order."""
    q = questions.select(F.col("id").alias("question_id"), F.posexplode(F.from_json("channels", "array<string>")).alias("position", "engine_id"))
    return q.join(engines.where("enabled").select(F.col("id").alias("engine_id"), "name"), "engine_id")


def lookup_chain(keys: DataFrame, first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Rows of first (enabled ones), else of second, for each key."""
    a = first.where("enabled").select(key, F.struct(*[c for c in first.columns if c != key]).alias("_a"))
    b = second.select(key, F.struct(*[c for c in first.columns if c != key]).alias("_b"))
    j = keys.select(key).join(a, key, "left").join(b, key, "left").withColumn("_x", F.coalesce("_a", "_b"))
    return j.where(F.col("_x").isNotNull()).select(key, "_x.*")


def nest(parent: DataFrame, child: DataFrame, key: str, fk: str, order: str, name: str, most: int | None = None, tie: str | None = None) -> DataFrame:
    """parent with an array of its children in order (empty without any); most: the first ones only, which are chosen before they are gathered."""
    if most is not None:
        w = Window.partitionBy(fk).orderBy(order, *([tie] if tie else []))
        child = child.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")
    inner = F.struct(order, *([tie] if tie else []), *(c for c in child.columns if c not in (fk, order, tie)))
    lists = child.groupBy(F.col(fk).alias(key)).agg(F.array_sort(F.collect_list(inner)).alias(name))
    none = F.array().cast(lists.schema[name].dataType)
    return parent.join(lists, key, "left").withColumn(name, F.coalesce(name, none))
