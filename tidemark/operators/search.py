"""Full-text search: a tokenizer, postings, a query language, BM25 ranking and tiered search with several passes.

bm25 reads the texts themselves. An index holds postings (doc, column, term, positions) in buckets of the term's hash, and
the length of every document; bm25_index ranks by it, and reads the buckets of the query's terms only where it is stored
partitioned by bucket. Both give the same documents and ranks.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

K1, B = 1.2, 0.75


def _folding() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and the same ones without."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for a, b in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for i in range(a, b)]
    pairs = [(x, y) for x, y in pairs if x != y and x.isalpha()]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


_MARKED, _BARE = _folding()


def fold(c: Column | str) -> Column:
    """Lower case, without accents and combining marks."""
    x = F.col(c) if isinstance(c, str) else c
    return F.lower(F.translate(F.regexp_replace(x, "\\p{Mn}+", ""), _MARKED, _BARE))


def fold_text(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


def terms(c: Column | str) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}\p{Co}]+)"))


def once(c: Column) -> Column:
    """A generator of one row, whose value later columns and filters take as it is: an alias would be replaced by its expression in each of them."""
    return F.explode(F.array(c))


def postings(docs: DataFrame, key: str, column: str, only: list[str] | None = None) -> DataFrame:
    """doc, term, tf, positions (from 0), length of the document; only: these terms, dropped before the shuffle."""
    t = docs.select(F.col(key).alias("doc"), once(terms(column)).alias("_t")).withColumn("length", F.size("_t"))
    at = t.select("doc", "length", F.posexplode("_t").alias("position", "term"))
    if only is not None:
        at = at.where(F.col("term").isin(only))
    return at.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"), F.first("length").alias("length"))


def vocabulary(docs: DataFrame, key: str, column: str) -> DataFrame:
    """term, documents, occurrences: counted in each task before terms meet, without places."""
    t = docs.select(F.col(key).alias("doc"), F.explode(terms(column)).alias("term"))
    return t.groupBy("term", "doc").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


# -- query language ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


class QueryError(ValueError):
    pass


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([():+*,])|([^\s"():+*,]+))')


def parse(query: str):
    """Tree of a query: terms and "phrases" with an optional * for prefixes, implicit AND, AND, OR, NOT, NEAR(.., n), column: filters, parentheses."""
    out, i = [], 0
    while i < len(query.rstrip()):
        m = _TOKEN.match(query, i)
        if not m:
            raise QueryError(f"cannot read the query at {i}")
        out.append(("phrase", m[1][1:-1].replace('""', '"')) if m[1] is not None else ("mark", m[2]) if m[2] else ("word", m[3]))
        i = m.end()
    at = 0

    def peek(k: int = 0):
        return out[at + k] if at + k < len(out) else (None, None)

    def take():
        nonlocal at
        at += 1
        return out[at - 1]

    def either():
        left = both()
        while peek() == ("word", "OR"):
            take()
            left = Op("or", left, both())
        return left

    def both():
        left = without()
        while True:
            if peek() == ("word", "AND"):
                take()
            elif peek()[0] is None or peek() in (("word", "OR"), ("mark", ")"), ("word", "NOT"), ("mark", ",")):
                return left
            left = Op("and", left, without())

    def without():
        left = single()
        while peek() == ("word", "NOT"):
            take()
            left = Op("not", left, single())
        return left

    def phrase(column=None):
        kind, s = take() if at < len(out) else (None, None)
        if kind not in ("word", "phrase") or kind == "word" and s in ("AND", "OR", "NOT"):
            raise QueryError(f"a term is missing before {s!r}" if s else "the query ends too early")
        if kind == "word" and not re.fullmatch(r"[\w\x80-\U0010ffff]+", s):
            raise QueryError(f"syntax error near {s!r}")
        words = tuple(re.findall(r"[^\W_]+", fold_text(s)))
        while peek() == ("mark", "+"):
            take()
            words += tuple(re.findall(r"[^\W_]+", fold_text(take()[1])))
        prefix = peek() == ("mark", "*")
        if prefix:
            take()
        return Phrase(words, prefix, column)

    def single(column=None):
        kind, s = peek()
        if (kind, s) == ("mark", "("):
            take()
            tree = either()
            if peek() != ("mark", ")"):
                raise QueryError("a parenthesis is open")
            take()
            return tree
        if (kind, s) == ("word", "NEAR") and peek(1) == ("mark", "("):
            take(), take()
            parts, far = [], 10
            while peek() not in (("mark", ")"), ("mark", ","), (None, None)):
                parts.append(phrase(column))
            if peek() == ("mark", ","):
                take()
                n = take()[1]
                if not n.isdigit():
                    raise QueryError("NEAR wants a number")
                far = int(n)
            if peek() != ("mark", ")"):
                raise QueryError("a parenthesis is open")
            take()
            return Near(tuple(parts), far)
        if kind == "word" and peek(1) == ("mark", ":"):
            take(), take()
            return single(s)
        return phrase(column)

    if not out:
        raise QueryError("the query is empty")
    tree = either()
    if at < len(out):
        raise QueryError(f"syntax error near {out[at][1]!r}")
    return tree


def leaves(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return leaves(tree.left) + (leaves(tree.right) if tree.kind != "not" else [])


def _phrase_at(t: Column, p: Phrase) -> Column:
    """Places where a phrase starts in an array of terms."""
    n = len(p.words)
    ok = lambda i: _all([(F.get(t, i + k).startswith(w) if p.prefix and k == n - 1 else F.get(t, i + k) == F.lit(w)) for k, w in enumerate(p.words)])
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))), lambda i: F.coalesce(ok(i), F.lit(False)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0] if conditions else F.lit(False)
    for c in conditions[1:]:
        out = out & c
    return out


def term_line(c: Column | str) -> Column:
    """The terms with a space on both sides of each, so that a phrase is a piece of text."""
    return F.concat(F.lit(" "), F.array_join(F.coalesce(terms(c), F.array().cast("array<string>")), " "), F.lit(" "))


def _piece(p: Phrase) -> str:
    return " " + " ".join(p.words) + ("" if p.prefix else " ")


def matches(tree, columns: dict[str, Column]) -> Column:
    """Whether lines of terms (by column name) satisfy a query."""

    def hits(p: Phrase) -> Column:
        if p.column and p.column not in columns:
            raise QueryError(f"no such column: {p.column}")
        out = F.lit(False)
        for n in ([p.column] if p.column else columns) if p.words else ():
            out = out | columns[n].contains(_piece(p))
        return out

    if isinstance(tree, Phrase):
        return hits(tree)
    if isinstance(tree, Near):
        first, *rest = tree.phrases

        def close(i: Column, p: Phrase):
            # words between the two, whichever comes first
            return lambda j: F.greatest(j - (i + len(first.words)), i - (j + len(p.words))) <= tree.distance

        def on(line: Column) -> Column:
            t = F.split(F.trim(line), " ")
            near = F.exists(_phrase_at(t, first), lambda i: _all([F.lit(True), *(F.exists(_phrase_at(t, p), close(i, p)) for p in rest)]))
            # places are only looked for where all phrases occur
            return F.when(_all([line.contains(_piece(p)) for p in tree.phrases]), near).otherwise(False)

        out = F.lit(False)
        for line in columns.values():
            out = out | on(line)
        return out
    a, b = matches(tree.left, columns), matches(tree.right, columns)
    return a & b if tree.kind == "and" else a | b if tree.kind == "or" else a & ~b


# -- ranking ----------------------------------------------------------------------------------------------------------


def _scored(docs: DataFrame, trees: list, key: str, columns: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """key, _k_ of the kept columns, and _hit and _rank of each query, of the documents that any of them matches: texts are read once for counts and once for ranks."""
    names = {c: F.col(f"_t.t{i}") for i, c in enumerate(columns)}
    d = docs.select(F.col(key), *(F.col(c).alias(f"_k_{c}") for c in keep), once(F.struct(*(term_line(c).alias(f"t{i}") for i, c in enumerate(columns)))).alias("_t"))
    # a term has a space before it, and the line ends with one
    length = sum((F.when(x == "  ", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) - 1) for x in names.values()), F.lit(0))
    wanted = list(dict.fromkeys(p for tree in trees for p in leaves(tree)))

    def frequency(p: Phrase) -> Column:
        found = ([names[p.column]] if p.column else list(names.values())) if p.words else []
        # by the first word, with the rest ahead: only it starts at a space, so no start is passed over
        head, rest = f" {p.words[0]}" if p.words else "", _piece(p)[len(p.words[0]) + 1 :] if p.words else ""
        count = lambda t: F.when(t.contains(_piece(p)), F.regexp_count(t, F.lit(f"{head}(?={rest})"))).otherwise(0)
        return sum((count(t) for t in found), F.lit(0))

    hits = {f"_hit{j}": matches(tree, names) for j, tree in enumerate(trees)}
    d = d.withColumns({"_length": length} | hits | {f"_f{i}": frequency(p) for i, p in enumerate(wanted)})
    d = d.drop("_t")
    stats = d.agg(F.count("*").alias("_n"), F.avg("_length").alias("_avg"), *(F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(wanted))))
    # one row of counts
    d = d.where(" OR ".join(hits)).join(F.broadcast(stats), how="cross")

    def score(tree) -> Column:
        out = F.lit(0.0)
        for p in dict.fromkeys(leaves(tree)):
            i = wanted.index(p)
            idf = F.greatest(F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(1e-6))
            f = F.col(f"_f{i}").cast("double")
            out = out + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_length") / F.col("_avg")))
        return out

    return d.withColumns({f"_rank{j}": -score(tree) for j, tree in enumerate(trees)})


def bm25(docs: DataFrame, query: str, key: str, columns: tuple[str, ...], limit: int | None = 20, offset: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents that match the query, best first: key, rank (negative; smaller is better), then the columns named in keep.

    Weights are those of the usual BM25 (k1 1.2, b 0.75) with the floor of 1e-6 under the inverse document frequency;
    lengths and frequencies are of all columns together, over all documents. Ties are broken by the key.
    """
    d = _scored(docs, [parse(query)], key, columns, keep)
    out = d.select(key, F.col("_rank0").alias("rank"), *(F.col(f"_k_{c}").alias(c) for c in keep))
    if limit is None:
        return out
    return out.orderBy("rank", key).offset(offset).limit(limit) if offset else out.orderBy("rank", key).limit(limit)


def passes(docs: DataFrame, queries: list[str], key: str, columns: tuple[str, ...], limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """pass (from 1), position, key, rank and the columns named in keep: the first `limit` rows of bm25 for each query, all from one reading of the texts.

    A query that cannot be parsed has no rows; the first one must be.
    """
    trees: dict[int, object] = {}
    for i, q in enumerate(queries):
        try:
            trees[i + 1] = parse(q)
        except QueryError:
            if i == 0:
                raise
    d = _scored(docs, list(trees.values()), key, columns, keep)
    each = F.array(*(F.when(F.col(f"_hit{j}"), F.struct(F.lit(i).alias("pass"), F.col(f"_rank{j}").alias("rank"))) for j, i in enumerate(trees)))
    rows = d.select(key, *(F.col(f"_k_{c}").alias(c) for c in keep), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    rows = rows.select(F.col("x.pass").alias("pass"), key, F.col("x.rank").alias("rank"), *keep)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("pass").orderBy("rank", key))).where(F.col("position") <= limit)


BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def index(docs: DataFrame, key: str, columns: tuple[str, ...], buckets: int = BUCKETS) -> DataFrame:
    """doc, column, term, positions, length, bucket: the postings of docs, and a row of bucket -1 with the length of each document."""
    none = F.array().cast("array<string>")
    split = F.struct(*(F.coalesce(terms(c), none).alias(f"t{i}") for i, c in enumerate(columns)))
    d = docs.select(F.col(key).alias("doc"), once(split).alias("_s"))
    # the terms of each column, and a term without letters for the document itself
    each = [F.struct(F.lit(c).alias("column"), F.col(f"_s.t{i}").alias("terms")) for i, c in enumerate(columns)]
    each.append(F.struct(F.lit("").alias("column"), F.array(F.lit("")).alias("terms")))
    d = d.select("doc", sum((F.size(f"_s.t{i}") for i in range(len(columns))), F.lit(0)).alias("length"), F.explode(F.array(*each)).alias("_e"))
    at = d.select("doc", "length", F.col("_e.column").alias("column"), F.posexplode("_e.terms").alias("position", "term"))
    p = at.groupBy("doc", "column", "term", "length").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    # rows that repeat a key and a length have been put together, but each is a document
    places = F.when(F.col("term") == "", F.transform("positions", lambda x: F.array().cast("array<int>"))).otherwise(F.array("positions"))
    bucket = F.when(F.col("term") == "", -1).otherwise(_bucket(F.col("term"), buckets))
    return p.select("doc", "column", "term", F.explode(places).alias("positions"), "length", bucket.alias("bucket"))


def bm25_index(postings: DataFrame, query: str, key: str, columns: tuple[str, ...], limit: int | None = 20, offset: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """key and rank of the documents that match the query, as bm25 gives them, from an index of these columns."""
    tree = parse(query)
    wanted = list(dict.fromkeys(leaves(tree)))
    for p in wanted:
        if p.column and p.column not in columns:
            raise QueryError(f"no such column: {p.column}")
    every = list(dict.fromkeys(_phrases(tree)))
    words = sorted({w for p in every for w in (p.words[:-1] if p.prefix else p.words)})
    heads = sorted({p.words[-1] for p in every if p.prefix and p.words})
    asked = F.col("term").isin(words)
    if heads:  # a prefix may be in any bucket
        for h in heads:
            asked = asked | F.col("term").startswith(h)
        asked = asked & (F.col("bucket") >= 0)
    else:
        asked = asked & F.col("bucket").isin(*(_bucket(F.lit(w), buckets) for w in words)) if words else F.lit(False)
    # of a document, its rows of bucket -1 and the postings of the query's terms: one reading for counts and ranks
    own = F.col("bucket") == -1
    d = postings.where(asked | own).groupBy("doc").agg(
        F.first("length").alias("_length"), F.collect_list(F.when(~own, F.struct("column", "term", "positions"))).alias("_p"),
        F.count(F.when(own, 1)).alias("_rows"), F.sum(F.when(own, F.col("length"))).alias("_sum"),
    )

    def places(column: str, word: str, prefix: bool) -> Column:
        named = F.filter("_p", lambda x: (x["column"] == column) & (x["term"].startswith(word) if prefix else x["term"] == word))
        return F.flatten(F.transform(named, lambda x: x["positions"]))

    def starts(p: Phrase, column: str) -> Column:
        if not p.words:
            return F.array().cast("array<int>")
        n = len(p.words)
        out = places(column, p.words[0], p.prefix and n == 1)
        for k in range(1, n):
            out = F.filter(out, after(places(column, p.words[k], p.prefix and k == n - 1), k))
        return out

    def after(found: Column, k: int):
        return lambda i: F.array_contains(found, i + k)

    def hit(t) -> Column:
        if isinstance(t, Phrase):
            return F.size(F.concat(*(starts(t, c) for c in ([t.column] if t.column else columns)))) > 0
        if isinstance(t, Near):
            first, *rest = t.phrases
            near = lambda i, p, c: F.exists(starts(p, c), lambda j: F.greatest(j - (i + len(first.words)), i - (j + len(p.words))) <= t.distance)
            all_near = lambda c: lambda i: _all([F.lit(True), *(near(i, p, c) for p in rest)])
            out = F.lit(False)
            for c in columns:
                out = out | F.exists(starts(first, c), all_near(c))
            return out
        x, y = hit(t.left), hit(t.right)
        return x & y if t.kind == "and" else x | y if t.kind == "or" else x & ~y

    frequency = {f"_f{i}": sum((F.size(starts(p, c)) for c in ([p.column] if p.column else columns)), F.lit(0)) for i, p in enumerate(wanted)}
    d = d.withColumns({"_hit": hit(tree)} | frequency).drop("_p")
    met = d.agg(F.sum("_rows").alias("_n"), (F.sum("_sum") / F.sum("_rows")).alias("_avg"), *(F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(wanted))))
    d = d.where("_hit").join(F.broadcast(met), how="cross")  # one row of counts
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(1e-6))
        f = F.col(f"_f{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_length") / F.col("_avg")))
    out = d.select(F.col("doc").alias(key), (-score).alias("rank"))
    if limit is None:
        return out
    return out.orderBy("rank", key).offset(offset).limit(limit) if offset else out.orderBy("rank", key).limit(limit)


def _phrases(tree) -> list[Phrase]:
    """All phrases of a query, those behind NOT included."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return _phrases(tree.left) + _phrases(tree.right)


def variants(query: str) -> list[str]:
    """The query as a phrase and, of more than two words, its halves."""
    words = [w for w in re.split(r"[ \t\n]+", query) if w]
    half = len(words) // 2
    return ([f'"{query}"'] + ([" ".join(words[:half]), " ".join(words[half:])] if len(words) > 2 else [])) if query else []


def tiered(docs: DataFrame, query: str, key: str, columns: tuple[str, ...], tier: str = "free", most_passes: int = 0, limit: int = 20, trust: str | None = None, postings: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """key, pass, position, score, place of a tiered search; postings: an index of docs to rank by, in place of their texts.

    The free tier is one pass. The premium tier adds passes for the query's variants (up to most_passes in all, 3 by
    default; one that cannot be parsed is passed over), keeps the first occurrence of a document, and orders by trust:
    the place counts from the end times the multiplier of the trust level.
    """
    most = most_passes or (3 if tier == "premium" else 1)
    asked = [query] if tier == "free" or most <= 1 else [query, *variants(query)][:most]
    keep = (trust,) if trust else ()
    if postings is None:
        found = passes(docs, asked, key, columns, limit, keep)
    else:
        found = None
        for i, q in enumerate(asked):
            try:
                one = bm25_index(postings, q, key, columns, limit, buckets=buckets)
            except QueryError:
                if i == 0:
                    raise
                continue
            if keep:  # at most `limit` rows
                one = docs.select(key, *keep).join(F.broadcast(one), key)
            one = one.withColumn("pass", F.lit(i + 1))
            found = one if found is None else found.unionByName(one)
        found = found.withColumn("position", F.row_number().over(Window.partitionBy("pass").orderBy("rank", key)))  # at most `limit` rows a pass
    first = F.row_number().over(Window.partitionBy(key).orderBy("pass", "position"))
    found = found.withColumn("_first", first).where("_first = 1").drop("_first")
    whole = Window.orderBy("pass", "position")
    if len(asked) == 1:
        return found.select(key, "pass", "position", F.round("rank", 9).alias("score"), F.row_number().over(whole).alias("place"))
    n = F.count("*").over(Window.partitionBy())
    boosted = (n - F.row_number().over(whole) + 1) * (rules.trust_multiplier(trust) if trust else F.lit(1.0))
    found = found.withColumn("score", boosted).withColumn("_whole", F.row_number().over(whole))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "_whole"))).where(F.col("place") <= limit).select(key, "pass", "position", "score", "place")


def trust_order(rows: DataFrame, order: tuple[str, ...], trust: str) -> DataFrame:
    """rows of one answer (a page of results, not a table) in their order, with score (place from the end times the trust multiplier) and the place by it; ties keep their order."""
    w = Window.orderBy(*order)
    n = rows.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    n = n.withColumn("score", (F.col("_n") - F.col("_i") + 1) * rules.trust_multiplier(trust))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "_i"))).drop("_i", "_n")


def maintain(stored: DataFrame, key: str, columns: tuple[str, ...] | str, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """An index (of postings(), with the name of its column) after rows were inserted or changed (both: inserted) and deleted (keys)."""
    gone = [x.select(F.col(key).alias("doc")) for x in (inserted, deleted) if x is not None]
    out = stored
    for g in gone:
        out = out.join(g.distinct(), "doc", "left_anti")
    if inserted is None:
        return out
    new = postings(inserted, key, columns) if isinstance(columns, str) else index(inserted, key, columns)
    return out.unionByName(new.select(*out.columns))
