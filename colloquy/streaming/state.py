"""State machines over keyed feeds in order of event time.

Rows of a key are held back in its state until the watermark has passed them,
and are then acted upon in order, however they were delivered; what a state is
due to do at a time (a lease that runs out, media that come of age) is done when
the watermark passes that time, in whatever micro-batch the row arrived. A row
is late if its group has been acted upon beyond the row's time: it is dropped
and counted by the query (late_rows). A state that has nothing left to do is
cleared.

Keys share BUCKETS groups, and rows and states travel and wait as Arrow tables
of many of them: a call into the state store costs milliseconds, and a row that
passes Python by itself costs tens of microseconds. A machine acts on all rows
of a group that are due at once, by operations on columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups that keys are dealt to; a checkpoint is bound to their number.
BUCKETS = 256
#: Rows or states in one value of a list state, and rows that a task sorts into groups at once.
PART = 20_000
PACKED = 200_000
#: A time that doesn't come.
NEVER = 2**63 - 1

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def store(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which timers need; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def late_rows(query) -> int:
    """Rows that a query dropped as late, in all micro-batches it still knows of."""
    progress = query.recentProgress
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) + sum(p["observedMetrics"]["late"]["late"] or 0 for p in progress if "late" in p["observedMetrics"])


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(part: bytes) -> pa.Table:
    with pa.ipc.open_stream(part) as rows:
        return rows.read_all()


def parts(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """Where parts of at most PART rows begin and end."""
    return ((lo, min(lo + PART, len(rows))) for lo in range(0, len(rows), PART))


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_group, lo, part): the rows of each group, packed, with the time of the first of them."""
    def dealt(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        rows = rows.take(np.argsort(rows["_group"].to_numpy(), kind="stable"))
        group, at = rows["_group"].to_numpy(), rows["at_us"].to_numpy()
        rows = rows.drop_columns("_group")
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        cuts = [(a + lo, a + hi) for a, b in zip(edges, edges[1:]) for lo, hi in parts(rows.slice(a, b - a))]
        first = np.array([at[a:b].min() for a, b in cuts])
        return pa.record_batch({"_group": group[[a for a, _ in cuts]], "lo": first, "part": [packed(rows.slice(a, b - a)) for a, b in cuts]})

    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if n >= PACKED:
            yield dealt(waiting)
            waiting, n = [], 0
    if n:
        yield dealt(waiting)


def in_order(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Rows by key, time and tie; those alike in all three in an order that doesn't depend on their delivery."""
    key = pd.factorize(rows["_key"])[0]
    order = np.lexsort((rows["tie"], rows["at_us"], key))
    rows, key = rows.iloc[order].reset_index(drop=True), key[order]
    same = (np.diff(key) == 0) & (np.diff(rows["at_us"]) == 0) & (np.diff(rows["tie"]) == 0)
    if same.any():
        alike = np.flatnonzero(np.append(same, False) | np.append(False, same))
        run = np.cumsum(np.append(True, ~same))[alike]
        text = [str(x) for x in rows.loc[alike, names[2:]].itertuples(index=False, name=None)]
        order = np.arange(len(rows))
        order[alike] = alike[np.lexsort((np.array(text), run))]
        rows = rows.iloc[order].reset_index(drop=True)
    return rows


def flags(column: pd.Series) -> np.ndarray:
    """Booleans of which null ones are false."""
    return (column == True).to_numpy(bool)  # noqa: E712


class Ordered(StatefulProcessor):
    """Hands the rows of a group that the watermark has passed to act(), in order, with the states of its keys; and again when something is due.

    ``held`` is the schema of a row, which begins with at_us and tie; ``kept`` is
    that of the states, a table with _key; ``given`` that of the output.
    """

    held: str
    kept: str
    given: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getListState("now", "part binary")
        self.rows = handle.getListState("rows", "lo bigint, part binary")
        self.clock = handle.getValueState("clock", "timer bigint, until bigint")

    def act(self, states: pd.DataFrame, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame, pd.DataFrame, int]:
        """States after ``rows`` (sorted by key, time and tie) and all that is due by ``until``; the output; and when something is due next, or NEVER.

        A row at a deadline comes before it.
        """
        raise NotImplementedError

    @staticmethod
    def _names(schema: str) -> list[str]:
        return [x.split()[0] for x in schema.split(",")]

    @classmethod
    def _table(cls, schema: str, found: list[pa.Table]) -> pd.DataFrame:
        return pa.concat_tables(found).to_pandas(integer_object_nulls=True) if found else pd.DataFrame({n: [] for n in cls._names(schema)}).astype({x.split()[0]: "int64" for x in schema.split(",") if x.endswith("bigint")})

    def _clock(self) -> tuple[int | None, int]:
        """The timer that is set, and up to when the group has been acted upon."""
        return self.clock.get() if self.clock.exists() else (None, -NEVER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, until = self._clock()
        first, late = NEVER, 0
        for frame in rows:
            for lo, part in zip(frame["lo"], frame["part"]):
                if lo <= until:
                    fresh = unpacked(part)
                    at = fresh["at_us"].to_numpy()
                    late += int((at <= until).sum())
                    if not (at > until).any():
                        continue
                    lo, part = int(at[at > until].min()), packed(fresh.filter(at > until))
                self.rows.appendValue((int(lo), bytes(part)))
                first = min(first, int(lo))
        self._wake(timer, until, first)
        if late:
            columns = (x.split() for x in self.given.split(","))
            yield pd.DataFrame({n: [0 if t == "bigint" else ""] for n, t in columns} | {"late": [late]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for lo, part in self.rows.get():
            if lo > until:
                later.append((lo, part))
                continue
            rows = unpacked(part)
            at = rows["at_us"].to_numpy()
            ready.append(rows.filter(at <= until))
            if (at > until).any():
                later.append((int(at[at > until].min()), packed(rows.filter(at > until))))
        if ready:
            self._put(self.rows, later)
        rows = in_order(self._table(f"_key string, {self.held}", ready), self._names(self.held))
        states, out, due = self.act(self._table(self.kept, [unpacked(part) for (part,) in self.now.get()]), rows, until)
        kept = pa.Table.from_pandas(states, preserve_index=False)
        self._put(self.now, [(packed(kept.slice(a, b - a)),) for a, b in parts(kept)])
        self._wake(None, until, min([due, *(lo for lo, _ in later)]))
        if len(out):
            yield out.assign(late=0)

    @staticmethod
    def _put(held, values: list[tuple]) -> None:
        held.clear()
        for value in values:
            held.appendValue(value)

    def _wake(self, timer: int | None, until: int, at: int) -> None:
        """One timer a group, at the first thing to do. A timer rings when the watermark is beyond it, so it is set a millisecond before."""
        if at < NEVER and (timer is None or -(-at // 1000) - 1 < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = -(-at // 1000) - 1
            self.handle.registerTimer(timer)
        self.clock.update((timer, until))

    def close(self) -> None:
        pass


class CallWatch(Ordered):
    """What each call is due: to be processed when it is ready, reclaimed when its lease runs out, purged of media when these come of age.

    A write replaces what was known of its call. So what a write leads to depends
    on it and on the time of the next one alone, and a state is the times at
    which the last write of a call comes due.
    """

    held = "at_us bigint, tie bigint, status string, media_us bigint, has_video boolean"
    kept = "_key string, since_us bigint, lease_us bigint, audio_us bigint, video_us bigint"
    given = "call_id string, action string, since_us bigint, due_us bigint"

    def __init__(self, lease_us: int, audio_us: int, video_us: int):
        self.lease, self.audio, self.video = lease_us, audio_us, video_us

    def _writes(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The state that each write puts its call into."""
        since, known = rows["at_us"].to_numpy("int64"), rows["media_us"].notna().to_numpy(bool)
        media = np.where(known, rows["media_us"], 0).astype("int64")
        done = (rows["status"] == "delivered").to_numpy(bool) & known
        aged = lambda age, which: np.where(which & (age >= 0), np.maximum(since, media + age), NEVER)
        lease = np.where(rows["status"].isin(["transcribing", "summarizing"]), since + self.lease, NEVER)
        return pd.DataFrame({"_key": rows["_key"], "since_us": since, "lease_us": lease, "audio_us": aged(self.audio, done), "video_us": aged(self.video, done & flags(rows["has_video"]))})

    def act(self, states, rows, until):
        each = pd.concat([x for x in (states, self._writes(rows)) if len(x)] or [states], ignore_index=True)
        key = pd.factorize(each["_key"])[0]
        order = np.argsort(key, kind="stable")  # states came first, rows are in order
        each, key = each.iloc[order].reset_index(drop=True), key[order]
        since, last = each["since_us"].to_numpy(), np.append(key[1:] != key[:-1], True)[: len(key)]
        limit = np.where(last, until, np.append(since[1:], 0)[: len(key)] - 1)
        ready = rows[(rows["status"] == "ready-to-process").to_numpy(bool)]
        out = [self._acts(ready["_key"], "process", ready["at_us"], ready["at_us"])]
        for column, action in (("lease_us", "reclaim"), ("audio_us", "purge-audio"), ("video_us", "purge-video")):
            due = each[column].to_numpy().copy()
            hit = due <= limit
            out.append(self._acts(each["_key"][hit], action, since[hit], due[hit]))
            if action == "reclaim":
                out.append(self._acts(each["_key"][hit], "process", due[hit], due[hit]))
            due[hit] = NEVER
            each[column] = due
        left = each[["lease_us", "audio_us", "video_us"]].min(axis=1).to_numpy("int64")
        kept = last & (left < NEVER)
        return each[kept], pd.concat(out, ignore_index=True), int(left[kept].min(initial=NEVER))

    @staticmethod
    def _acts(key, action, since, due) -> pd.DataFrame:
        return pd.DataFrame({"call_id": np.asarray(key, object), "action": action, "since_us": np.asarray(since, "int64"), "due_us": np.asarray(due, "int64")})


def _filled(values: np.ndarray, first: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """``values`` with each negative one replaced by the last before it; a key's first, where negative, by ``initial``."""
    values = np.where(first & (values < 0), initial, values)
    return values[np.maximum.accumulate(np.where(values >= 0, np.arange(len(values)), 0))]


def _summed(values: np.ndarray, first: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Running sums of a key's values, from ``initial`` on."""
    total = np.cumsum(values)
    starts = np.flatnonzero(first)
    return total - (total - values)[starts][np.cumsum(first) - 1] + initial


class VoiceRoom(Ordered):
    """Closed calls of a channel: who is present, whether it is armed, and when the open call began.

    step() is the machine, a row at a time; act() does the same over many rows.
    Of its states one row a channel has no user: whether it's armed (flag) and
    when its call began; the others are who is present, and if they are triggers (flag).
    """

    held = "at_us bigint, tie bigint, user_id string, is_bot boolean, role_id string, action string"
    kept = "_key string, user_id string, flag boolean, started_us bigint"
    given = "channel_id string, started_us bigint, ended_us bigint"

    def __init__(self, users: list[str], roles: list[str]):
        self.users, self.roles = set(users), set(roles)

    def fresh(self) -> dict[str, Any]:
        return {"present": {}, "triggers": 0, "armed": False, "started": None}

    def _moved(self, state, row) -> None:
        """Who is present, and how many of them are triggers, after a join or leave."""
        user = row["user_id"] or ""
        state["triggers"] -= state["present"].pop(user, False)
        if row["action"] == "join":
            state["present"][user] = row["user_id"] in self.users or row["role_id"] in self.roles
            state["triggers"] += state["present"][user]

    def step(self, key: tuple, state: dict, row: dict) -> tuple[dict, list[Row]]:
        out = []
        if row["action"] in ("arm", "disarm"):
            state["armed"] = row["action"] == "arm"
        elif not row["is_bot"]:
            self._moved(state, row)
        if state["started"] is None:
            if state["armed"] and state["present"] and (state["triggers"] or not (self.users or self.roles)):
                state["started"] = row["at_us"]
        elif not state["present"] or row["action"] == "disarm":
            out.append(Row(channel_id=key[0], started_us=state["started"], ended_us=row["at_us"]))
            state["started"] = None
        return state, out

    def act(self, states, rows, until):
        code, names = pd.factorize(pd.concat([states["_key"], rows["_key"]]))
        known, key = code[: len(states)], code[len(states) :]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        action, at = rows["action"], rows["at_us"].to_numpy("int64")
        person = states["user_id"].notna().to_numpy(bool)
        flag = flags(states["flag"])
        armed, started = np.zeros(len(names), bool), np.full(len(names), NEVER)
        armed[known[~person]], started[known[~person]] = flag[~person], states["started_us"].to_numpy("int64")[~person]

        # who was present before each join and leave: those of the states, then the rows in order
        moved = ~action.isin(["arm", "disarm"]).to_numpy(bool) & ~flags(rows["is_bot"])
        moves, n = rows[moved], int(person.sum())
        room = np.append(known[person], key[moved])
        user, users = pd.factorize(pd.concat([states["user_id"][person], moves["user_id"].fillna("")]))
        here = np.append(np.ones(n, bool), moves["action"] == "join").astype(bool)
        trigger = here & np.append(flag[person], moves["user_id"].isin(self.users) | moves["role_id"].isin(self.roles)).astype(bool)
        who = room.astype("int64") * max(len(users), 1) + user
        order = np.argsort(who, kind="stable")
        same = who[order[1:]] == who[order[:-1]]
        was, was_trigger = np.zeros(len(who), bool), np.zeros(len(who), bool)
        was[order[1:]], was_trigger[order[1:]] = here[order[:-1]] & same, trigger[order[:-1]] & same
        stay = order[np.append(~same, True)[: len(order)]]
        stay = stay[here[stay]]

        def count(now: np.ndarray, before: np.ndarray) -> np.ndarray:
            change = np.zeros(len(rows), "int64")
            change[moved] = now[n:].astype("int64") - before[n:]
            return _summed(change, first, np.bincount(room[:n], now[:n], len(names)).astype("int64")[key])

        humans, triggers = count(here, was), count(trigger, was_trigger)
        ready = _filled(np.where(action == "arm", 1, np.where(action == "disarm", 0, -1)), first, armed[key])
        on = (ready == 1) & (humans > 0) & ((triggers > 0) | (not (self.users or self.roles)))
        off = (humans == 0) | (action == "disarm").to_numpy(bool)
        open_ = _filled(np.where(on, 1, np.where(off, 0, -1)), first, started[key] < NEVER)
        before = np.where(first, started[key] < NEVER, np.append(0, open_[:-1])[: len(key)])
        flip = np.flatnonzero(open_ != before)
        began = np.append(NEVER, at[flip][:-1])[: len(flip)]
        turn = np.append(True, np.diff(key[flip]) != 0)[: len(flip)]
        began[turn] = started[key[flip]][turn]
        end = open_[flip] == 0
        out = pd.DataFrame({"channel_id": names[key[flip][end]], "started_us": began[end], "ended_us": at[flip][end]})

        last = np.append(key[1:] != key[:-1], True)[: len(key)]
        armed[key[last]] = ready[last] == 1
        started[key[flip]] = np.where(end, NEVER, at[flip])  # of a channel's flips the last one stays
        rooms = np.flatnonzero(armed | (started < NEVER))
        left = pd.DataFrame({"_key": np.append(names[rooms], names[room[stay]]), "user_id": np.append(np.full(len(rooms), None, object), np.asarray(users[user[stay]], object)), "flag": np.append(armed[rooms], trigger[stay]), "started_us": np.append(started[rooms], np.full(len(stay), NEVER))})
        return left, out, NEVER


def ordered(stream: DataFrame, key: str, time: str, tie: str, delay: str, processor: Ordered) -> DataFrame:
    """The rows that ``processor`` gives of a feed with event time ``time``; rows later than ``delay`` behind the newest are dropped."""
    rows = stream.withColumn("at_time", F.col(time).cast("timestamp")).withWatermark("at_time", delay)
    rows = rows.withColumns({"at_us": F.unix_micros("at_time"), "tie": F.col(tie).cast("long")})
    group = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_group")
    dealt = rows.select(group, F.col(key).alias("_key"), *processor._names(processor.held)).mapInArrow(by_group, "_group int, lo bigint, part binary")
    out = dealt.groupBy("_group").transformWithStateInPandas(processor, f"{processor.given}, late bigint", "append", "eventTime")
    return out.observe("late", F.sum("late").alias("late")).where("late = 0").drop("late")
