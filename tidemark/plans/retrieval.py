"""Queries over indexes that are written first: segments of postings with block bounds, and codes of vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunks
from ..operators import codes, trees
from ..operators.segments import Segments
from ..operators.shared import new_folder

_TERMS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"


def ranked_sql(frequencies: list[str], limit: int) -> str:
    """The best documents by BM25 that have all leaves; a leaf is a condition on a term x."""
    n = range(len(frequencies))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))" for i in n)
    return f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
        f AS (SELECT doc_id, len(t) AS l, {", ".join(f"len(list_filter(t, lambda x: {c}))::DOUBLE AS f{i}" for i, c in enumerate(frequencies))} FROM d),
        s AS (SELECT count(*) AS n, avg(l) AS a, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in n)} FROM f),
        r AS (SELECT doc_id, -({score}) AS rank FROM f, s WHERE {" AND ".join(f"f{i} > 0" for i in n)} ORDER BY rank, doc_id LIMIT {limit})
        SELECT doc_id, round(rank, 9) AS rank FROM r
    """


_CHUNKS = f"""
    d AS (SELECT doc_id, idx, {_TERMS} AS t FROM x),
    f AS (SELECT doc_id, idx, len(t) AS l, len(list_filter(t, lambda x: x = 'the'))::DOUBLE AS f0, len(list_filter(t, lambda x: x = 'of'))::DOUBLE AS f1 FROM d),
    s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f),
    r AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, lang, -(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))
        + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))) AS rank
        FROM f CROSS JOIN s JOIN documents USING (doc_id) JOIN labels USING (doc_id) WHERE f0 > 0 AND f1 > 0 AND lang IN ('en', 'de') AND quality = 1 ORDER BY rank, doc_id, idx LIMIT 20)
    SELECT doc_id, idx, lang, round(rank, 9) AS rank FROM r
"""


def register(query, table) -> None:
    def indexed(spark, d):
        index = Segments(spark, new_folder(spark, "segments"), "doc_id", ("text",), buckets=16)
        index.change(table(spark, d, "documents"))
        return index

    @query(ranked_sql(["x = 'the'", "x = 'of'"], 20))
    def fts_topk_blockmax(spark, d):
        """The best twenty documents with two frequent words: only blocks whose bound reaches the twentieth's score are read."""
        return indexed(spark, d).ranked("the of").withColumn("rank", F.round("rank", 9))

    @query(ranked_sql(["starts_with(x, 'th')", "x = 'of'"], 50))
    def fts_prefix(spark, d):
        """The best fifty with a word that begins in th, and another: the dictionary names the buckets of the words."""
        return indexed(spark, d).ranked("th* of", 50).withColumn("rank", F.round("rank", 9))

    @query("""
        WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'new ' || source ELSE text END AS text FROM documents WHERE doc_id % 3 = 1 OR doc_id % 3 = 2 AND doc_id % 7 <> 0),
        t AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS term FROM x) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term
    """)
    def fts_index_segments(spark, d):
        """The vocabulary of an index after two inserts, a change of some documents with a deletion of others, and merges."""
        docs = table(spark, d, "documents").select("doc_id", "source", "text")
        index = Segments(spark, new_folder(spark, "segments"), "doc_id", ("text",), buckets=16)
        old = docs.where("doc_id % 3 = 1 OR doc_id % 3 = 2")
        index.change(old.where("doc_id % 2 = 0"))
        index.change(old.where("doc_id % 2 = 1"))
        index.change(docs.where("doc_id % 3 = 1").select("doc_id", F.concat(F.lit("new "), "source").alias("text")), docs.where("doc_id % 7 = 0").select("doc_id"))
        index.merge(fan=2)
        return index.vocabulary()

    @query(r"""
        WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS t FROM documents),
        n AS (SELECT *, len(t) AS n, greatest(CAST(ceil((len(t) - 512) / 448) AS BIGINT) + 1, 1) AS k FROM w WHERE len(t) > 0),
        c AS (SELECT doc_id, t, text, n, k, CASE WHEN k > 1 AND n - (k - 1) * 448 < 32 THEN k - 1 ELSE k END AS kept FROM n),
        i AS (SELECT *, unnest(generate_series(0, kept - 1)) AS idx FROM c),
        x AS (SELECT doc_id, idx, CASE WHEN n <= 512 THEN text ELSE array_to_string(t[idx * 448 + 1 : least(idx * 448 + 512, n)], ' ') || CASE WHEN kept < k AND idx = kept - 1 THEN ' ' || array_to_string(t[(k - 1) * 448 + 1 : n], ' ') ELSE '' END END AS text FROM i),
    """ + _CHUNKS)
    def fts_chunk_search(spark, d):
        """Chunks that match, with the language and quality of their documents: of two languages, and of one quality. Ranks are those among all chunks."""
        docs = table(spark, d, "documents")
        c = chunks.chunk_table(docs.select("doc_id", "text")).select(F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("idx").cast("string"), 6, "0")).alias("id"), F.col("chunk_text").alias("text"))
        index = Segments(spark, new_folder(spark, "segments"), "id", ("text",), key_type="string", buckets=16)
        index.change(c)
        part = lambda n: F.split("id", "/")[n].cast("long")
        found = index.ranked("the of", None).select(part(0).alias("doc_id"), part(1).cast("int").alias("idx"), "rank")
        about = docs.select("doc_id", "lang").where(F.col("lang").isin("en", "de")).join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id")
        return found.join(about, "doc_id").orderBy("rank", "doc_id", "idx").limit(20).select("doc_id", "idx", "lang", F.round("rank", 9).alias("rank"))

    @query()
    def vector_codes(spark, d):
        """The five nearest of every fiftieth vector, by codes of a sixth of the vectors' size; measured against vector_neighbours in the tests."""
        v = table(spark, d, "embeddings")
        coder = codes.fit_codes(v, k=5)
        path = new_folder(spark, "codes")
        codes.encoded(v, coder).write.partitionBy("cell").parquet(path)
        index = spark.read.parquet(path)
        return codes.near_by_codes(index, v, v.where("vec_id % 50 = 0"), coder, 5).withColumn("score", F.round("score", 6))

    @query(r"""
        WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)([^>]*)>.*?</', '<\1\2></', 'gs') AS h FROM pages),
        t AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)[ />]', 1)) AS tag FROM p) SELECT page_id, tag, count(*) AS nodes FROM t GROUP BY page_id, tag
    """)
    def node_index(spark, d):
        """Elements of each tag of each page, from the table of nodes."""
        return trees.node_table(table(spark, d, "pages")).where("tag IS NOT NULL").groupBy("page_id", "tag").agg(F.count("*").alias("nodes"))

    @query(r"""
        WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)"', 1) AS a FROM pages)
        SELECT page_id, CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS place, unnest(a) AS href FROM l WHERE len(a) > 0
    """)
    def node_xpath(spark, d):
        """The links of each page's navigation by child and descendant steps, in their order."""
        found = trees.select(trees.node_table(table(spark, d, "pages")), "//nav/ul/li//a[@href]")
        place = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
        return found.select("page_id", place.alias("place"), F.col("attrs")["href"].alias("href"))

    @query()
    def node_density(spark, d):
        """The share of text in each child of a page's body, by its path; tested against the trees themselves."""
        return trees.densities(trees.node_table(table(spark, d, "pages")))
