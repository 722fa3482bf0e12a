"""State machines act on many rows at once as they would on each row by itself."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from colloquy.plans import feeds
from colloquy.streaming import state

QUEUE = [*"recording ready-to-process transcribing summarizing delivered failed".split()]


def frame(rows, schema):
    names = ["_key", *state.Ordered._names(schema)]
    rows = pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="int64" if n in ("at_us", "tie") else object) for i, n in enumerate(names)})
    return state.in_order(rows.sample(frac=1, random_state=len(rows)), state.Ordered._names(schema))


def watched(writes, lease, audio, video):
    """Actions and when they are due, call by call and write by write."""
    out = []
    for key in {w[0] for w in writes}:
        own = sorted(w[1:] for w in writes if w[0] == key)
        for (at, _, status, media, has_video), after in zip(own, [*(w[0] for w in own[1:]), None]):
            due = []
            if status == "ready-to-process":
                out.append((key, "process", at, at))
            if status in ("transcribing", "summarizing"):
                due = [("reclaim", at + lease), ("process", at + lease)]
            if status == "delivered" and media is not None:
                due = [("purge-audio", max(at, media + audio))] * (audio >= 0) + [("purge-video", max(at, media + video))] * (video >= 0 and bool(has_video))
            out += [(key, action, d if action == "process" else at, d) for action, d in due if after is None or d < after]
    return sorted(out)


@pytest.mark.parametrize("audio, video", [(50, 20), (-1, 30), (0, -1)])
def test_calls_are_watched_at_once_as_one_by_one(audio, video):
    rng = random.Random(audio)
    writes = [(f"c{rng.randrange(40)}", at, i, rng.choice(QUEUE), rng.choice([None, at - 30, at + 9]), rng.choice([None, True, False])) for i in range(600) for at in [rng.randrange(300)]]
    watch, got = state.CallWatch(7, audio, video), []
    states, dues = watch._table(watch.kept, []), []
    for lo, until in ((-1, 80), (80, 81), (81, 200), (200, 299), (299, 299), (299, 5000)):
        states, out, due = watch.act(states, frame([w for w in writes if lo < w[1] <= until], watch.held), until)
        assert ((out["due_us"] <= until) & (due > until)).all()
        got += list(out.itertuples(index=False, name=None))
        dues.append(due)
    assert sorted(got) == watched(writes, 7, audio, video) and not len(states) and dues[-1] == state.NEVER


@pytest.mark.parametrize("users, roles", [(["u1"], ["r3"]), ([], [])])
@pytest.mark.parametrize("seed", range(4))
def test_rooms_are_followed_at_once_as_row_by_row(users, roles, seed):
    rng = random.Random(seed)
    log = [(rng.choice(["v", "w", "x"]), i // 2, i, rng.choice(["u1", "u2", "u3", "", None]), rng.choice([True, False, False, None]), rng.choice(["r3", "r4", None]), rng.choice(["join", "leave", "leave", "arm", "arm", "disarm"])) for i in range(400)]
    room, got, want, loops = state.VoiceRoom(users, roles), [], [], {}
    names = room._names(room.held)
    states = room._table(room.kept, [])
    for part in (log[:1], log[1:150], [], log[150:151], log[151:]):
        states, out, due = room.act(states, frame(part, room.held), 0)
        states = state.unpacked(state.packed(pa.Table.from_pandas(states, preserve_index=False))).to_pandas()
        got += list(out.itertuples(index=False, name=None))
        assert due == state.NEVER
    for key, *row in log:
        loops[key], out = room.step((key,), loops.get(key) or room.fresh(), dict(zip(names, row)))
        want += [tuple(r) for r in out]
    assert sorted(got) == sorted(want) and want
    assert sorted((k, u) for k, u in zip(states["_key"], states["user_id"]) if u is not None) == sorted((k, u) for k, x in loops.items() for u in x["present"])


class Held:
    """A state of one key, in memory."""

    def __init__(self):
        self.values = []

    def get(self):
        return iter(self.values)

    def clear(self):
        self.values = []

    appendValue = lambda self, value: self.values.append(value)


class Clock(Held):
    exists = lambda self: bool(self.values)
    get = lambda self: self.values[-1]
    update = Held.appendValue


class Handle:
    """One group's states and timers in memory, and its watermark."""

    def __init__(self):
        self.timers, self.ms = [], 0

    getListState = lambda self, *_: Held()
    getValueState = lambda self, *_: Clock()
    registerTimer = lambda self, at: self.timers.append(at)
    deleteTimer = lambda self, at: self.timers.remove(at)
    getCurrentWatermarkInMs = lambda self: self.ms


def test_rows_travel_packed_and_a_late_one_is_dropped_from_among_its_part():
    watch, handle = state.CallWatch(5_000_000, -1, -1), Handle()
    watch.init(handle)
    rows = lambda *ats: pa.record_batch({"_group": pa.array([3] * len(ats), pa.int32()), "_key": [f"c{at}" for at in ats], "at_us": [at * 1000 for at in ats], "tie": [0] * len(ats), "status": ["ready-to-process"] * len(ats), "media_us": pa.array([None] * len(ats), pa.int64()), "has_video": [False] * len(ats)})
    parts = list(state.by_group(iter([rows(20, 10), rows(30, 90)])))
    assert [(b["_group"].to_pylist(), b["lo"].to_pylist()) for b in parts] == [([3], [10_000])]
    assert not list(watch.handleInputRows((3,), iter([parts[0].to_pandas()]), handle)) and handle.timers == [9]
    handle.ms = 30
    out = pd.concat(watch.handleExpiredTimer((3,), handle, None))
    assert sorted(out["since_us"]) == [10_000, 20_000, 30_000] and handle.timers == [9, 89]
    late = pd.concat(watch.handleInputRows((3,), iter([b.to_pandas() for b in state.by_group(iter([rows(29, 30, 31, 70)]))]), handle))
    assert late["late"].tolist() == [2] and list(late.columns) == [*watch._names(watch.given), "late"]
    handle.ms = 100
    assert sorted(pd.concat(watch.handleExpiredTimer((3,), handle, None))["since_us"]) == [31_000, 70_000, 90_000]


def test_a_feed_in_slices_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(frames):
        for x in frames:
            seen.add(len(x))
            yield x

    rows = spark.range(1000).selectExpr("CAST(id AS STRING) AS channel_id", "CAST(TIMESTAMP_SECONDS(id) AS TIMESTAMP_NTZ) AS ts")
    path, schema, delay, files = feeds.in_slices(spark, rows.mapInPandas(look, rows.schema), "ts", "2030-01-01", "once")
    assert seen.value == 2000 and files == 1  # for its span of time, and to be dealt
    assert spark.read.schema(schema).parquet(path).where("channel_id <> ''").distinct().count() == 1000
    assert len(spark.read.schema(schema).parquet(path).inputFiles()) == feeds.SLICES + 3
