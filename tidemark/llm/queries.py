"""The registered queries of this subpackage, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepiece
from .common import table
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .licences import FILE_SHARE, LEAST, SPEAKS, TEMPLATES, TERM, document_paths, licence_scan, weigh
from .metric_join import metric_join
from .mixing import mix
from .near_dedup import near_dedup
from .quality_model import quality_model
from .quality_rules import quality_rules
from .suffix_dedup import suffix_dedup
from .token_scan import document_token_counts
from .toxicity import toxicity

TOKENIZERS = "/opt/tokenizers"
SENTENCEPIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_RANKS, BYTE_EOD = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", 50256
#: Fixed value: the pattern that splits text before the merges of BYTE_RANKS.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("distance", F.round("distance", 6))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(BYTE_RANKS, "rb") as f:
        ranks = f.read()
    return document_token_counts(table(spark, sf_dir, "documents"), ranks, BYTE_PATTERN, BYTE_EOD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("events", "clause_weight")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(document_paths(table(spark, sf_dir, "documents")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = sentencepiece.encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL, column="decoded")
    return decoded.select("doc_id", *sentencepiece.digest(decoded))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), target_entropy_share=0.95, repetition_limit=4.0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_quality_model": op7_quality_model,
    "op8_licences": op8_licences,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_mixing": op10_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_metric_join": op13_metric_join,
}

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS p FROM d WHERE length(h) >= 100)),
        g AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) < doc_id AS dup FROM w),
        r AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM g WHERE dup),
        i AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
        x AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
        y AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM x GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(generate_series(0, len(a)), lambda j: substr(h, 2 * CASE WHEN j = 0 THEN 0 ELSE b[j] END + 1,
                2 * (CASE WHEN j = len(a) THEN length(h) // 2 ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE b[j] END))), '') END)) AS kept_sha256
        FROM d LEFT JOIN y USING (doc_id)
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, sha256(array_to_string(t[i : i + 4], ' ')) AS g FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(len(t) - 4, 1))) AS i FROM w WHERE len(t) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, min(r.root) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
    """,
}

ORACLE["op11_source_divergence"] = """
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
    o AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
    f AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
    l AS (SELECT lang, term, sum(c) AS c FROM o JOIN f USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM l GROUP BY lang),
    n AS (SELECT lang, source, sum(c) AS n FROM o JOIN f USING (lang, term) GROUP BY ALL),
    x AS (SELECT g.lang, g.source, l.term, coalesce(o.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (l.c + 1)) // (v.n + v.v) AS q
        FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = l.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM x WHERE c > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM z)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLE["op13_metric_join"] = ORACLE["op4_near_dedup"].replace("t[i : i + 4]", "t[i : i + 3]").replace("len(t) - 4", "len(t) - 3").replace(">= 75 *", ">= 85 *").replace(", min(r.root) = w.doc_id AS kept", "")
ORACLE["op12_hard_negatives"] = """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT * FROM n WHERE rank <= 10
"""


def _licence_sql() -> str:
    """The licence scan of document_paths: a file lies in a source, in a language of it, or in a hundred of that."""
    rows, unknown = weigh(TEMPLATES)
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quoted(name)}, {quoted(term)}, {unit!r})" for i, name, term, unit in rows)
    counts: dict[str, int] = {}
    for _, _, term, _ in rows:
        counts[term] = counts.get(term, 0) + 1
    weights = ", ".join(f"({quoted(t)}, ln({1 + len(TEMPLATES)}.0 / {1 + n}) + 1)" for t, n in counts.items())
    return f"""
        WITH known(template, licence, term, unit) AS (VALUES {known}), weights(term, idf) AS (VALUES {weights}),
        e AS (SELECT doc_id, '/' || coalesce(source, 'unknown') AS top, '/' || coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS mid, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
        d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN top WHEN 1 THEN mid ELSE mid || '/' || (doc_id // 100) END AS folder FROM e),
        l AS (SELECT doc_id, top, folder, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SPEAKS}')) AS lines FROM d WHERE regexp_matches(text, '{SPEAKS}')),
        f AS (SELECT *, len(regexp_extract_all(array_to_string(lines, chr(10)), '\\S+')) >= {FILE_SHARE} * len(regexp_extract_all(text, '\\S+')) AS is_file FROM l),
        p AS (SELECT doc_id, top, folder, is_file, unnest(CASE WHEN is_file THEN list_append(lines, array_to_string(lines, ' ')) ELSE lines END) AS line FROM f),
        t AS (SELECT line, term, count(*) AS n FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM (SELECT DISTINCT line FROM p)) GROUP BY line, term),
        v AS (SELECT t.line, t.term, n * coalesce(idf, {unknown!r}) AS w, idf FROM t LEFT JOIN weights USING (term)),
        z AS (SELECT line, sqrt(sum(w * w)) AS norm FROM v GROUP BY line),
        c AS (SELECT v.line, template, licence, round(sum(w * unit) / any_value(norm), 9) AS s FROM v JOIN known USING (term) JOIN z USING (line) GROUP BY v.line, template, licence),
        m AS (SELECT line, max((s, -template, licence)) AS b FROM c WHERE s >= {LEAST} GROUP BY line),
        o AS (SELECT doc_id, any_value(top) AS top, any_value(folder) AS folder, bool_or(is_file) AS is_file, max((b[1], b[3])) AS x FROM p JOIN m USING (line) GROUP BY doc_id),
        k AS (SELECT folder, max(x) AS y FROM o WHERE is_file GROUP BY folder),
        u AS (SELECT d.*, coalesce(a.y, b.y, c.y) AS y, CASE WHEN a.y IS NOT NULL THEN d.folder WHEN b.y IS NOT NULL THEN mid WHEN c.y IS NOT NULL THEN d.top END AS above
            FROM d LEFT JOIN k a ON a.folder = d.folder LEFT JOIN k b ON b.folder = d.mid AND d.doc_id % 3 <> 0 LEFT JOIN k c ON c.folder = d.top)
        SELECT u.doc_id, u.folder || '/' || u.doc_id || '.txt' AS path, coalesce(o.x[2], u.y[2]) AS licence, round(coalesce(o.x[1], u.y[1]), 6) AS similarity,
            CASE WHEN o.x IS NOT NULL THEN CASE WHEN o.is_file THEN 'file' ELSE 'header' END WHEN u.y IS NOT NULL THEN 'inherited' ELSE 'none' END AS found, CASE WHEN o.x IS NULL AND u.y IS NOT NULL THEN u.above END AS from_folder
        FROM u LEFT JOIN o USING (doc_id)
    """


ORACLE["op8_licences"] = _licence_sql()
