"""State machines over feeds that come in several batches, out of order, with late rows and a clock that moves on."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.operators import lifecycle as L
from colloquy.operators import voice as V
from colloquy.streaming import feeds as S
from colloquy.streaming import state

T0 = datetime(2024, 1, 1)
STATUS = "call_id string, seq int, status string, updated_at timestamp, started_at timestamp, ended_at timestamp, has_video boolean"
VOICE = "event_id long, ts timestamp, channel_id string, user_id string, is_bot boolean, role_id string, action string"


class Feed:
    """A folder that batches are dropped into, and a query over it that is run again and again on one checkpoint."""

    def __init__(self, spark, tmp_path, schema, build):
        self.spark, self.schema, self.build = spark, schema, build
        self.path, self.out, self.offsets = (str(tmp_path / x) for x in ("feed", "out", "offsets"))
        self.late = 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def run(self):
        with state.store(self.spark):
            stream = self.build(S.source(self.spark, self.path, self.spark.createDataFrame([], self.schema).schema, 1))
            query = stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.offsets).trigger(availableNow=True).start()
            query.awaitTermination()
        self.late += state.late_rows(query)
        return sorted(tuple(r) for r in self.spark.read.schema(stream.schema).parquet(self.out).collect())


def hours(n):
    return T0 + timedelta(hours=n)


def test_calls_of_an_early_batch_are_acted_upon_when_their_time_comes(spark, tmp_path):
    """At each step of the clock, what has been done is what the sweeps of a table would have found by then."""
    feed = Feed(spark, tmp_path, STATUS, lambda s: S.stream_queue(s, 60, 2, 1, "0 seconds"))
    kinds = ["transcribing", "summarizing", "delivered", "recording", "failed", "delivered"]
    calls = [(f"c{i}", 1, kinds[i % 6], hours(i % 7), hours(-i), hours(0) if i % 2 else None, i % 3 == 0) for i in range(24)]
    feed.put(calls)
    table = spark.createDataFrame(calls, STATUS).withColumns({"thread_id": F.lit(None).cast("string"), "emailed_at": F.lit(None).cast("timestamp")})
    for now in (6, 7, 8, 30, 31, 60):
        feed.put([("", 0, "recording", hours(now), hours(0), None, False)])
        got = feed.run()
        known = table.where(F.col("updated_at") <= F.lit(hours(now)))
        stale = {r.call_id for r in L.reclaim_stale(known, hours(now), 60).collect()}
        audio, video = ({r.call_id for r in L.expired(known, hours(now), days, video=v).collect()} for days, v in ((2, False), (1, True)))
        done = {a: {c for c, x, _, _ in got if x == a} for a in ("reclaim", "purge-audio", "purge-video", "process")}
        assert (done["reclaim"], done["purge-audio"], done["purge-video"], done["process"]) == (stale, audio, video, stale)
    assert len(got) == len({(c, a, since) for c, a, since, _ in got}) and feed.run() == got


def test_a_write_before_its_deadline_calls_it_off_however_it_comes(spark, tmp_path):
    feed = Feed(spark, tmp_path, STATUS, lambda s: S.stream_queue(s, 60, -1, -1, "3 hours"))
    at = lambda seq, status, h: ("a", seq, status, hours(h), T0, None, False)
    feed.put([at(2, "summarizing", 1.5), at(0, "ready-to-process", 0)])
    feed.put([at(1, "transcribing", 0.5), at(3, "delivered", 3)])  # out of order; only the lease of the second runs out
    feed.put([("", 0, "recording", hours(99), T0, None, False)])
    assert feed.run() == [("a", "process", hours(0), hours(0)), ("a", "process", hours(2.5), hours(2.5)), ("a", "reclaim", hours(1.5), hours(2.5))]


def test_a_second_reclaim_is_acted_upon_and_a_repeated_write_is_not(spark, tmp_path):
    feed = Feed(spark, tmp_path, STATUS, lambda s: S.stream_queue(s, 15, -1, -1, "0 seconds"))
    for h in (0, 2, 2):
        feed.put([("x", 1, "transcribing", hours(h), T0, None, False)])
    feed.put([("", 0, "recording", hours(9), T0, None, False)])
    assert [(since, due) for _, action, since, due in feed.run() if action == "reclaim"] == [(hours(0), hours(0.25)), (hours(2), hours(2.25))]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_voice_events_give_the_sessions_of_the_log(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = [(i, T0 + timedelta(minutes=i), rng.choice("xy"), rng.choice("abcd"), False, "r", rng.choice(["join", "join", "leave", "arm", "disarm"])) for i in range(300)]
    log = [(*r[:4], r[3] == "d", *r[5:]) for r in log]
    feed = Feed(spark, tmp_path, VOICE, lambda s: S.stream_voice_sessions(s, ["a"], [], "40 minutes"))
    order = sorted(log, key=lambda r: r[0] + rng.uniform(0, 35))
    for part in itertools.batched(order, 75):
        feed.put(part)
    end = (0, T0 + timedelta(days=9), "", "", True, "", "clock")
    feed.put([end])
    want = [tuple(r) for r in V.voice_sessions(spark.createDataFrame(log, VOICE), ["a"], []).where("ended_at is not null").select("channel_id", "started_at", "ended_at").collect()]
    assert feed.run() == sorted(want) and want and feed.late == 0
    # what comes now is too late: dropped, counted, and nothing changes
    feed.put([(900 + i, T0 + timedelta(minutes=i), "x", "a", False, "r", "arm") for i in range(7)])
    assert feed.run() == sorted(want) and feed.late == 7


def test_late_bursts_are_counted(spark, tmp_path):
    """A burst is late when the watermark has passed its end and the silence after it; the watermark that counts is that of the batch before."""
    feed = Feed(spark, tmp_path, "user_id string, ts timestamp, dur_ms long", lambda s: S.stream_utterances(s, 1000, "10 seconds"))
    at = lambda sec, dur: ("u", T0 + timedelta(seconds=sec), dur)
    feed.put([at(0, 500), at(100, 500)])
    feed.put([at(95, 500), at(110, 500)])  # within the delay
    feed.put([at(98, 500), at(50, 60_000), at(60, 500), at(61, 500)])  # the watermark was at 90: one ends at 110, and two are late
    feed.put([("v", T0 + timedelta(days=1), 0)])
    got = [r for r in feed.run() if r[0] == "u"]
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert sorted(((a - base) // 1000, (b - base) / 1000, n) for _, a, b, n in got) == [(0, 0.5, 1), (50, 110.5, 5)]
    assert feed.late == 2


def test_state_is_held_by_group_and_not_by_key(spark, tmp_path):
    """Hundreds of calls to the state store would take longer than all else: many calls share a value of it."""
    feed = Feed(spark, tmp_path, STATUS, lambda s: S.stream_queue(s, 60, 2, 1, "0 seconds"))
    feed.put([(f"c{i}", 1, "transcribing", hours(i % 7), hours(0), None, False) for i in range(3000)])
    with state.store(spark):
        query = feed.build(S.source(spark, feed.path, spark.createDataFrame([], STATUS).schema)).writeStream.format("memory").queryName("grouped").option("checkpointLocation", feed.offsets).trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 10 * state.BUCKETS


def test_a_room_with_many_members_is_not_listed_for_every_event():
    room, now = state.VoiceRoom(["u1"], []), None
    now = room.fresh()
    for i in range(20_000):
        now, out = room.step(("v",), now, {"action": "join", "user_id": f"u{i}", "is_bot": False, "role_id": "r", "at_us": i})
    assert len(now["present"]) == 20_000 and now["triggers"] == 1
    now, _ = room.step(("v",), now, {"action": "arm", "user_id": "x", "is_bot": False, "role_id": "r", "at_us": 20_000})
    assert now["started"] == 20_000
    now, out = room.step(("v",), now, {"action": "disarm", "user_id": "x", "is_bot": False, "role_id": "r", "at_us": 20_001})
    assert [tuple(r) for r in out] == [("v", 20_000, 20_001)]
