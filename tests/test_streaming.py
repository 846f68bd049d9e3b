import os
import random
from datetime import datetime, timedelta
from pathlib import Path

from orrery.operators import steps
from orrery.streaming import sessions, usage

SF = "/root/testdata/sf0.001"


def test_daily_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = usage.events(spark, f"{tmp_path}/in")
    q = usage.daily(rows, "60 days").writeStream.outputMode("complete").format("memory").queryName("daily_usage").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = lambda r: (str(r.usage_date), r.event_type, r.calls, r.total_tokens)
    expected = usage.daily_batch(batch.selectExpr("*", "cast(get_json_object(props, '$.k') as long) tokens")).collect()
    assert sorted(map(key, spark.table("daily_usage").collect())) == sorted(map(key, expected))


def test_append_is_idempotent(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/in")
    for n in range(2):  # the second run starts without the first one's checkpoint
        q = usage.append_facts(usage.events(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check{n}")
        assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000


KINDS = "session string, seq int, type string, payload string, ts timestamp"


def run(rows, name, path):
    q = rows.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{path}/c-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return rows.sparkSession.table(name)


def stream(spark, batches, kinds, path):
    """A stream that reads each batch as one file, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{path}/b{k:03}")
        for f in Path(f"{path}/b{k:03}").glob("*.parquet"):
            os.makedirs(f"{path}/in", exist_ok=True)
            target = f"{path}/in/{k:03}.parquet"
            os.rename(f, target)
            os.utime(target, (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def row(r):
    return (r.session, r.message, r.n_events, r.n_missing, r.ttft_ms, r.thinking_ms, r.outcome)


def test_one_session(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("s", k + 1, kind, payload, t + timedelta(milliseconds=ms)) for k, (kind, payload, ms) in enumerate([("meta", None, 0), ("reasoning", "h", 40), ("delta", "Hel", 100), ("delta", "lo", 130), ("done", None, 150)])]
    out = run(sessions.sessions(stream(spark, [rows], KINDS, tmp_path)), "one_session", tmp_path).collect()
    assert [row(r) for r in out] == [("s", "Hello", 5, 0, 100, 60, "done")]


def test_shuffled_events_give_the_batch_result(spark, tmp_path):
    """Events in any order over many batches, repeated ones, errors, cancelled sessions and lost events."""
    r, t, rows = random.Random(4), datetime(2024, 1, 1), []
    for s in range(40):
        n, at = r.randint(1, 12), 0
        own = []
        for k in range(n):
            at += r.randint(0, 90)
            kind = "meta" if k == 0 else r.choice(["delta", "delta", "reasoning", "tool"]) if k < n - 1 else r.choice(["done", "error", "delta"])
            own.append((f"s{s}", k + 1, kind, r.choice([None, f"<{k}>"]), t + timedelta(seconds=s, milliseconds=at)))
        if s % 7 == 3:
            del own[r.randrange(n)]
        rows += own + own[:2] * (s % 3 == 0)
    expected = sorted(row(x) for x in sessions.sessions_batch(spark.createDataFrame(rows, KINDS)).collect())
    assert {e[6] for e in expected} == {"done", "error", "cancelled"} and any(e[3] for e in expected)
    r.shuffle(rows)
    end = [("end", 1, "done", None, t + timedelta(days=1))], [("end2", 1, "done", None, t + timedelta(days=1))]  # moves the watermark past all timers
    out = run(sessions.sessions(stream(spark, [rows[k::6] for k in range(6)] + [*end], KINDS, tmp_path)), "shuffled_sessions", tmp_path)
    assert sorted(row(x) for x in out.where("session not like 'end%'").collect()) == expected


def test_steps_are_paired(spark, tmp_path):
    r, t, rows = random.Random(5), datetime(2024, 1, 1), []
    for k in range(60):
        at = r.randint(0, 400)
        rows.append((f"q{k % 9}", f"s{k}", "start", t + timedelta(seconds=at)))
        rows += [(f"q{k % 9}", f"s{k}", "finish", t + timedelta(seconds=at + r.randint(-3, 50))) for _ in range(r.randint(0, 3))]
    kinds = "request string, step_id string, kind string, ts timestamp"
    batch = spark.createDataFrame(rows, kinds).selectExpr("*", "unix_millis(ts) at_ms")
    expected = {(x.request, x.step_id, x.cost_ms) for x in steps.collected(batch, "request").collect()}
    r.shuffle(rows)
    end = [[("end", f"e{k}", kind, t + timedelta(days=1 + k)) for kind in ("start", "finish")] for k in range(2)]
    out = run(sessions.paired_steps(stream(spark, [rows[k::4] for k in range(4)] + end, kinds, tmp_path)), "paired_steps", tmp_path)
    assert {(x.request, x.step_id, x.cost_ms) for x in out.where("request <> 'end'").collect()} == expected and None in {e[2] for e in expected}


def test_visits_equal_batch(spark, tmp_path):
    batch = usage.events(spark, f"{SF}/events.parquet")
    finite = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "cast(get_json_object(props, '$.k') as long) tokens")
    last = finite.agg({"ts": "max"}).first()[0]
    late = [[(-1 - k, last + timedelta(days=9 + k), -1, 0)] for k in range(2)]
    rows = [tuple(x) for x in finite.collect()]
    random.Random(6).shuffle(rows)
    out = run(sessions.visits(stream(spark, [rows[:500], rows[500:], *late], "event_id long, ts timestamp, user_id long, tokens long", tmp_path), "4 hours", "60 days"), "visit_rows", tmp_path)
    assert batch.isStreaming and out.count() == 0  # nothing is older than the watermark yet
    out = run(sessions.visits(stream(spark, [rows, *late], "event_id long, ts timestamp, user_id long, tokens long", tmp_path / "b"), "4 hours", "1 day"), "visit_rows2", tmp_path)
    key = lambda x: (x.user_id, x.started, x.n_events, x.total_tokens)
    assert sorted(map(key, out.where("user_id >= 0").collect())) == sorted(map(key, sessions.visits(finite, "4 hours").collect()))
