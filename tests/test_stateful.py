"""Replayed streams against the batch forms, and state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import mutations, stateful

FAR = 10_000_000


def replay(spark, tmp_path, rows, schema, make, files=4, time_of="ts_ms"):
    """What a stream gives over the rows in files that are read one after another; then the state's rows after a far later one."""
    ahead = sorted(rows, key=lambda r: r[1])
    step = max(1, -(-len(ahead) // files))
    folder = f"{tmp_path}/in"
    for i in range(0, len(ahead), step):
        spark.createDataFrame(ahead[i : i + step], schema).coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder).withColumn("ts", F.timestamp_millis(time_of))
    got, name = make(stream), f"q{random.randrange(1 << 40)}"

    def run():
        q = got.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    q = run()
    return spark.table(name), q.lastProgress["stateOperators"][0]["numRowsTotal"]


RECORD = "page_id string, ts_ms long, n long, source string, xpath string, op string, name string, value string"


def records(seed, n=400, span=6000):
    rng = random.Random(seed)
    return [(f"p{rng.randrange(3)}", 1000 + rng.randrange(span), i, rng.choice(["cdp", "js", "js"]), f"/a{rng.randrange(3)}", rng.choice(["attr", "text"]), rng.choice([None, "id"]), "v") for i in range(n)]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_echoes_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = records(1)
    end = ("end", FAR, 10**6, "js", "/", "text", None, "v")
    got, state = replay(spark, tmp_path, [*rows, end], RECORD, lambda s: stateful.remove_echoes(s, late="1 second"))
    want = sorted(r.n for r in mutations.drop_echoes_batch(spark.createDataFrame(rows, RECORD).fillna({"name": ""})).collect())
    assert sorted(r.n for r in got.collect() if r.page_id != "end") == want and 0 < len(want) < len(rows)
    assert state <= 2  # of the last row only: its value and its timer


@pytest.mark.parametrize("most", [1000, 7])
def test_batches_end_by_quiet_or_count(spark, tmp_path, most):
    rng = random.Random(3)
    rows = [("hot", 1000 + 10 * i + rng.randrange(9), i, "js", "/", "text", None, str(i)) for i in range(2500)] + [(f"p{i % 5}", 1000 + 137 * i, 5000 + i, "js", "/", "text", None, None) for i in range(300)]
    end = ("end", FAR, 10**6, "js", "/", "text", None, "v")
    got, state = replay(spark, tmp_path, [*rows, end], RECORD, lambda s: stateful.flush(s, late="1 second", most=most))
    batch = mutations.quiet_batches(spark.createDataFrame(rows, RECORD), most=most)
    first = batch.groupBy("page_id", "batch").agg(F.min(F.struct("ts_ms", "n")).alias("f"))
    want = sorted((r.n, r.f.ts_ms, r.f.n) for r in batch.join(first, ["page_id", "batch"]).collect())
    assert sorted((r.n, r.batch_ms, r.batch_n) for r in got.collect() if r.page_id != "end") == want
    assert state <= 3


def test_batches_refer_to_the_last_snapshot(spark, tmp_path):
    rng = random.Random(5)
    schema = "page_id string, timestamp long, id string, kind string"
    rows = [(f"p{rng.randrange(4)}", 1000 + rng.randrange(60_000), f"i{i}", rng.choice(["batch", "batch", "snap"])) for i in range(300)]
    end = [("end", FAR, "e", "batch"), ("end", 2 * FAR, "e2", "batch")]
    make = lambda s: stateful.as_of_snapshots(s.where("kind = 'batch'"), s.where("kind = 'snap'"), late="1 second")
    got, state = replay(spark, tmp_path, [*rows, *end], schema, make, files=5, time_of="timestamp")
    df = spark.createDataFrame(rows, schema)
    want = sorted((r.id, r.snapshot_ref) for r in mutations.with_snapshots(df.where("kind = 'batch'").drop("kind"), df.where("kind = 'snap'").drop("kind")).collect())
    found = sorted((r.id, r.snapshot_ref) for r in got.collect() if r.page_id != "end")
    ties = {t for _, t, _, k in rows if k == "snap"}
    assert len(found) == len(want) and [x for x, y in zip(found, want, strict=True) if x != y and dict((r[2], r[1]) for r in rows)[x[0]] not in ties] == []
    assert state <= 12  # a snapshot for each page, and the last row
