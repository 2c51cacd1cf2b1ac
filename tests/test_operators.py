"""Operators that SQL can't express, against plain versions on small inputs."""

import random

from pyspark.sql import functions as F

from tessera.operators.layout import cluster_rows, reading_order
from tessera.operators.runs import Run, reduce_events, reduce_sessions, run_row
from tessera.streaming.sessions import stream_sessions

BLOCK = "doc long, page int, block int, x0 double, y0 double, x1 double, y1 double, text string, width double"
EVENT = "session_id long, seq long, kind string, at_ms long, question string, answer string"


def pages(seed=3, n=40):
    r = random.Random(seed)
    return [
        (d, p, b, x := float(r.randrange(0, 400)), y := r.randrange(0, 60) / 2, x + r.randrange(10, 200), y + r.randrange(0, 12) / 2, "text " * r.randrange(1, 6), 600.0)
        for d in range(n) for p in (1, 2) for b in range(r.randrange(1, 12))
    ]


def test_rows_are_greedy(spark):
    rows = pages()
    want = {}
    for key in {(r[0], r[1]) for r in rows}:
        base = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            k = next((i for i, b in enumerate(base) if abs(b - r[6]) <= 3), len(base))
            base += [r[6]] * (k == len(base))
            want[r[:3]] = k
    found = cluster_rows(spark.createDataFrame(rows, BLOCK)).collect()
    assert {(r.doc, r.page, r.block): r.row for r in found} == want
    assert cluster_rows(spark.createDataFrame([], BLOCK)).collect() == []


def test_reading_order_of_columns(spark):
    prose = "a line of real prose here"
    rows = [
        (1, 1, 0, 20.0, 0.0, 580.0, 10.0, "a heading across the page", 600.0),
        (1, 1, 1, 20.0, 20.0, 250.0, 30.0, prose, 600.0), (1, 1, 2, 320.0, 21.0, 550.0, 31.0, prose, 600.0),
        (1, 1, 3, 20.0, 40.0, 250.0, 50.0, prose, 600.0), (1, 1, 4, 320.0, 41.0, 550.0, 51.0, prose, 600.0),
        (2, 1, 0, 20.0, 0.0, 250.0, 10.0, None, 600.0),
    ]
    found = reading_order(spark.createDataFrame(rows, BLOCK)).collect()
    order = [(r.block, r.band, r.col) for r in sorted(found, key=lambda r: r.place) if r.doc == 1]
    assert order == [(0, 0, 0), (1, 1, 0), (3, 1, 0), (2, 1, 1), (4, 1, 1)]
    assert [r.place for r in found if r.doc == 2] == [0]
    assert reading_order(spark.createDataFrame([], BLOCK)).collect() == []


def test_reading_order_keeps_every_block(spark):
    rows = pages(seed=5)
    found = reading_order(spark.createDataFrame(rows, BLOCK)).collect()
    assert sorted((r.doc, r.page, r.block) for r in found) == sorted(r[:3] for r in rows)
    for key in {(r[0], r[1]) for r in rows}:
        places = sorted(r.place for r in found if (r.doc, r.page) == key)
        assert places == list(range(len(places)))


def sessions(seed=7, n=30):
    r = random.Random(seed)
    return [(s, k, r.choice(["answer", "answer", "pause", "resume", "commit"]), 1000 * k + r.randrange(900), f"q{r.randrange(4)}", r.choice(["", "x", None])) for s in range(n) for k in range(r.randrange(1, 15))]


def reduced(rows, limit):
    out = []
    for s in sorted({r[0] for r in rows}):
        events = sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1]))
        out.append(run_row(s, reduce_events(Run(), [(r[2], r[3], r[4], r[5]) for r in events], limit)))
    return out


def test_sessions_of_a_batch(spark):
    rows = sessions()
    found = reduce_sessions(spark.createDataFrame(rows, EVENT), 6000).orderBy("session_id").collect()
    assert [r.asDict() for r in found] == reduced(rows, 6000)


def test_sessions_of_a_stream(spark, tmp_path):
    """After micro-batches in order, the last state of each session is that of the batch."""
    rows = sessions()
    frame = spark.createDataFrame(rows, EVENT)
    for k in range(3):
        frame.where(F.floor(F.col("seq") / 5) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    query = stream_sessions(stream, 6000).writeStream.outputMode("update").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("runs").groupBy("session_id").agg(F.max_by(F.struct("*"), F.col("accepted") + F.col("rejected")).alias("r")).select("r.*").orderBy("session_id")
    assert [r.asDict() for r in last.collect()] == reduced(rows, 6000)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """Session 1 is idle for longer than the bound; its state goes, and that of the others stays."""
    batches = [[(1, 0, "answer", 1_000, "q", "x"), (2, 0, "answer", 2_000, "q", "x")], [(2, 1, "answer", 60_000, "q", "y")], [(2, 2, "answer", 120_000, "q", "y")], [(2, 3, "answer", 125_000, "q", "z")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    query = stream_sessions(stream, None, "10 seconds").writeStream.outputMode("update").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) == 2 and kept[-1] == 1
    last = spark.table("idle").where("session_id = 2").agg(F.max("accepted")).first()[0]
    assert last == 4
