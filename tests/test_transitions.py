import datetime as dt
import random

import pytest

from routelens.operators import transitions as t
from routelens.streaming import run_stream
from routelens.streaming import usage_stream as us

BEGIN = dt.datetime(2026, 1, 1)


def history(rng, runs=12, events=9):
    rows = []
    for run in range(runs):
        at = BEGIN + dt.timedelta(seconds=rng.randrange(100))
        for i in range(rng.randint(1, events)):
            at += dt.timedelta(seconds=rng.choice((1, 5, 60, 4000)))
            rows.append((f"r{run}", at, run * 100 + i, rng.choice((*t.STATES[1:5], *t.STATES[1:4], "completed", "failed", "queued"))))
    return rows


def plain(rows, end=None):
    """Each event's verdict by walking through the history of its run."""
    out, left = {}, {}
    for run in {r[0] for r in rows}:
        state, last = "", None
        for _, at, i, told in sorted((r for r in set(rows) if r[0] == run), key=lambda r: (r[1], r[2])):
            if last and (at - last).total_seconds() > t.TIMEOUT and state in ("queued", "running", "cancelling"):
                state = "interrupted"
            ok = told in t.NEXT[state]
            state, last = told if ok else state, at
            out[run, i] = (ok, state)
        left[run] = "interrupted" if state in t.OPEN else state
    return out, left


@pytest.mark.parametrize("seed", range(3))
def test_events_are_accepted_or_refused(spark, seed):
    rng = random.Random(seed)
    rows = history(rng) + [("hot", BEGIN + dt.timedelta(seconds=i), 10_000 + i, rng.choice(("queued", "running", "awaiting_review", "running"))) for i in range(150)]
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id string, at timestamp, ord long, state string")
    want, left = plain(rows)
    assert {(r.run_id, r.ord): (r.accepted, r.after) for r in t.run_events(df).collect()} == want
    assert {r.run_id: r.state for r in t.run_states(df).collect()} == left
    assert t.run_states(df.limit(0)).count() == 0


def test_stream_agrees_with_late_and_repeated_events(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(7)
    rows = sorted(history(rng, 6, 7), key=lambda r: r[1].timestamp() + rng.random() * 1500)  # some come late, within the watermark
    rows += rows[-3:]
    end = ("zz", max(r[1] for r in rows) + dt.timedelta(days=2), 999_999, "queued")
    schema = "run_id string, at timestamp, ord long, state string"
    for i, part in enumerate([rows[: len(rows) // 2], rows[len(rows) // 2 :], [end], [(*end[:2], 999_998, "failed")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = us.read_log(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    try:
        us.to_table(run_stream.run_states(stream, "1 hour"), "judged", f"{tmp_path}/c", "append").awaitTermination()
        got = spark.table("judged").where("run_id <> 'zz'").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want, left = plain(rows)
    assert {(r.run_id, r.ord): (r.accepted, r.after) for r in got if r.ord >= 0} == want
    assert {r.run_id for r in got if r.ord < 0} == {run for run, state in left.items() if state == "interrupted" and [v for (k, _), v in sorted(want.items()) if k == run][-1][1] in t.OPEN}


def test_saves_must_know_the_current_version(spark):
    rows = [("a", 1, None, "x"), ("a", 2, 1, "y"), ("a", 3, 1, "lost"), ("a", 4, None, "forced"), ("a", 5, 4, "z"), ("b", 1, 7, "no"), ("b", 2, None, None), ("b", 3, 2, "w"), (None, 9, None, "n")]
    df = spark.createDataFrame(rows, "item string, at long, expected long, content string").repartition(3)
    got = {(r.item, r.at): (r.taken, r.version, r.replaced) for r in t.saves(df).collect()}
    assert got == {("a", 1): (True, 1, None), ("a", 2): (True, 2, "x"), ("a", 3): (False, 2, None), ("a", 4): (True, 3, "y"), ("a", 5): (True, 4, "forced"), ("b", 1): (False, 0, None), ("b", 2): (True, 1, None), ("b", 3): (True, 2, None), (None, 9): (True, 1, None)}
