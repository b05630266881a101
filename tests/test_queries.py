"""Registered queries against their SQL, and against the whole of their tables."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__


def rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    key = lambda r: tuple(map(str, r))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    found = sorted(map(tuple, got.collect()), key=key)
    assert found == sorted(want, key=key)
    return found


def test_every_event_is_an_item(spark, sf_dir):
    found = rows(spark, sf_dir, "api_items")
    assert sorted(int(r[2]) for r in found) == sorted(r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    assert max(r[1] for r in found) < 100


def test_the_vocabulary_has_rare_terms(spark, sf_dir):
    assert min(r[1] for r in rows(spark, sf_dir, "fts_vocabulary")) == 1


def test_echoes_go_from_both_paths(spark, sf_dir):
    found = rows(spark, sf_dir, "echo_removal")
    assert sum(r[2] for r in found) < spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_cells_recall(spark, sf_dir):
    q = __spark_entry__.queries()
    want = {(r["query"], r.vec_id) for r in q["vector_neighbours"](spark, sf_dir).collect()}
    found = {(r["query"], r.vec_id) for r in q["vector_cells"](spark, sf_dir).collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_items_beyond_a_million_have_their_ids_as_titles(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(200).withColumn("event_id", F.col("event_id") + 999_900).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.title for r in __spark_entry__.queries()["api_items"](spark, str(tmp_path)).collect()}
    assert found == {str(r.event_id) for r in spark.read.parquet(f"{tmp_path}/events.parquet").collect()}
