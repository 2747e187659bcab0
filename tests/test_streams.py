"""Greedy near-duplicate state over a stream, against a plain loop in arrival order."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from curato.operators import nearness as nr
from curato.streaming import flows

SCHEMA = "scope string, id long, at timestamp, text string, v array<double>"
START = datetime.datetime(2024, 1, 1)


def streamed(spark, folder, files, least, live, late="1 second"):
    """Decisions after one file a micro-batch."""
    src, out = f"{folder}/in", f"{folder}/out"
    for n, rows in enumerate(files):
        spark.createDataFrame([(s, i, START + datetime.timedelta(seconds=at), t, v) for s, i, at, t, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        flows.run(flows.keep_first(flows.read_files(spark, src, SCHEMA, files=1), late, least, live), out, f"{folder}/state").awaitTermination()
    return {r.id: (r.how, r.like) for r in spark.read.parquet(out).collect()}


def looped(rows, least, live):
    out, kept = {}, []
    for s, i, at, t, v in rows:
        near = [(k, "same") for ks, k, kat, kt, _ in kept if ks == s and kat >= at - live and t is not None and kt == t]
        cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a and b and np.any(a) and np.any(b) else -2
        near += [(k, "alike") for ks, k, kat, _, kv in kept if ks == s and kat >= at - live and cos(kv, v) >= least]
        if near:
            out[i] = (near[0][1], near[0][0])
        else:
            out[i] = ("kept", None)
            kept.append((s, i, at, t, v))
    return out


def made(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 4))
    rows = []
    for i in range(n):
        v = (base[rng.integers(6)] + rng.normal(size=4) * 0.4).tolist()
        rows.append(("ab"[i % 2], i, float(i), None if i % 9 == 0 else f"t{rng.integers(12)}", None if i % 11 == 0 else [0.0] * 4 if i % 13 == 0 else v))
    return rows


@pytest.fixture
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("live", [1000, 8])
def test_stream_equals_the_loop(spark, tmp_path, provider, live):
    rows = made(45, live)
    files = [rows[:15], rows[15:30][::-1], rows[30:]]
    got, want = streamed(spark, tmp_path, files, 0.9, live), looped(rows, 0.9, live)
    assert got == want and {h for h, _ in want.values()} == {"kept", "same", "alike"}


def test_one_batch_equals_the_table(spark, tmp_path, provider):
    rows = [(s, i, at, None, v or [0.0] * 4) for s, i, at, _, v in made(60, 5)]
    got = streamed(spark, tmp_path, [rows[:20], rows[20:]], 0.8, 10_000)
    table = spark.createDataFrame([(i, v, s) for s, i, _, _, v in rows], "id long, v array<double>, scope string")
    assert {i for i, (how, _) in got.items() if how == "kept"} == {r.id for r in nr.dedup_embeddings(table, 0.8, "scope").select("id").collect()}


def test_late_rows_are_left_out(spark, tmp_path, provider):
    rows = [("a", 1, 100.0, "x", None), ("a", 2, 200.0, "y", None)]
    # the watermark after the first file is 199, so row 3 is too late and row 4 is not
    got = streamed(spark, tmp_path, [rows, [("a", 5, 201.0, "z", None)], [("a", 3, 50.0, "x", None), ("a", 4, 202.0, "y", None)]], 0.9, 1000)
    assert got == {1: ("kept", None), 2: ("kept", None), 5: ("kept", None), 4: ("same", 2)}


def test_progress_of_a_stream_of_windows(spark, tmp_path):
    """R-09, R-10: rows behind the watermark are dropped and counted; windows and sessions are those of the others."""
    schema, src = "ts timestamp, user long, value double", f"{tmp_path}/in"
    at = lambda s: START + datetime.timedelta(seconds=s)
    files = [[(at(0), 1, 1.0), (at(5), 1, 3.0), (at(70), 2, 5.0)], [(at(200), 1, 7.0)], [(at(10), 1, 100.0), (at(205), 1, 9.0)], [(at(900), 3, 0.0)], [(at(901), 3, 0.0)]]
    dropped = 0
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for kind, make in (("w", lambda d: flows.windowed(d, "ts", "10 seconds", "60 seconds", None, "user")), ("s", lambda d: flows.sessions(d, "ts", "10 seconds", "30 seconds", "user"))):
            q = flows.run(make(flows.read_files(spark, src, schema, files=1)), f"{tmp_path}/{kind}", f"{tmp_path}/{kind}-state")
            q.awaitTermination()
            dropped += sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) if kind == "w" else 0
    windows = {((r.start - START).seconds, r.user): (r.n, r["mean"]) for r in spark.read.parquet(f"{tmp_path}/w").collect()}
    assert windows == {(0, 1): (2, 2.0), (60, 2): (1, 5.0), (180, 1): (2, 8.0)} and dropped == 1
    sessions = {((r.start - START).seconds, (r.end - START).seconds, r.user): r.n for r in spark.read.parquet(f"{tmp_path}/s").where(F.col("user") < 3).collect()}
    assert sessions == {(0, 35, 1): 2, (70, 100, 2): 1, (200, 235, 1): 2}
