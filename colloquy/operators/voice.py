"""Voice channels and recordings: who is present, when a call runs, how bursts of speech line up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def humans(state: DataFrame) -> DataFrame:
    return state.where(~F.col("is_bot"))


def trigger_match(user_id: Column, roles: Column, users: list[str], role_ids: list[str]) -> Column:
    """Whether a member is a trigger user or has a trigger role."""
    by_user = user_id.isin(*users) if users else F.lit(False)
    by_role = F.arrays_overlap(roles, F.array(*map(F.lit, role_ids))) if role_ids else F.lit(False)
    return by_user | F.coalesce(by_role, F.lit(False))


def usable_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.where(F.col("has_audio") & ~F.col("sink_failed"))


ORDER = ["ts", "event_id"]


def occupancy(log: DataFrame, users: list[str], roles: list[str], slices: int | None = None) -> DataFrame:
    """Join, leave, arm and disarm events with people present (``humans``), trigger people (``triggered``) and ``armed`` after each.

    A join of someone present, or a leave of someone absent, changes nothing.
    Rows are those of scan.sliced(): a busy channel is spread over many tasks.
    """
    member = Window.partitionBy("channel_id", "user_id").orderBy(*ORDER)
    moves = log.where(F.col("action").isin("join", "leave"))
    here = F.col("action") == "join"
    was = F.coalesce(F.lag("action").over(member) == "join", F.lit(False))
    delta = F.when(F.col("is_bot") | (here == was), 0).when(here, 1).otherwise(-1)
    moves = moves.withColumn("d", delta).withColumn("dt", F.when(trigger_match(F.col("user_id"), F.array("role_id"), users, roles), F.col("d")).otherwise(0)).withColumn("command", F.lit(None).cast("int"))
    commands = log.where(F.col("action").isin("arm", "disarm")).withColumns({"d": F.lit(0), "dt": F.lit(0), "command": (F.col("action") == "arm").cast("int")})
    rows = scan.sliced(moves.unionByName(commands), ["channel_id"], ORDER, slices)
    rows = scan.running(rows, ["channel_id"], ORDER, {"humans": ("sum", F.col("d")), "triggered": ("sum", F.col("dt")), "armed": ("last", F.col("command"))})
    return rows.withColumn("armed", F.coalesce("armed", F.lit(0)) == 1).drop("d", "dt", "command")


def snapshot(log: DataFrame, users: list[str], roles: list[str]) -> DataFrame:
    """Of each channel at the end of the log: people, whether any matches a trigger, whether it is armed."""
    last = log.where(F.col("action").isin("join", "leave")).groupBy("channel_id", "user_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"), F.first("is_bot").alias("is_bot"), F.first("role_id").alias("role_id"))
    present = last.where("action = 'join'").groupBy("channel_id").agg(F.count_if(~F.col("is_bot")).alias("humans"), F.coalesce(F.bool_or(~F.col("is_bot") & trigger_match(F.col("user_id"), F.array("role_id"), users, roles)), F.lit(False)).alias("any_trigger"))
    armed = log.where(F.col("action").isin("arm", "disarm")).groupBy("channel_id").agg((F.max_by("action", F.struct("ts", "event_id")) == "arm").alias("armed"))
    out = log.select("channel_id").distinct().join(present, "channel_id", "left").join(armed, "channel_id", "left")
    return out.select("channel_id", F.coalesce("humans", F.lit(0)).alias("humans"), F.coalesce("any_trigger", F.lit(False)).alias("any_trigger"), F.coalesce("armed", F.lit(False)).alias("armed"))


def should_join(state: DataFrame, recording: Column, has_triggers: bool) -> DataFrame:
    ready = F.col("armed") & (F.col("humans") > 0) & (F.col("any_trigger") if has_triggers else F.lit(True))
    return state.withColumn("join", ready & ~recording)


def should_leave(state: DataFrame, recording: Column) -> DataFrame:
    return state.withColumn("leave", recording & (F.col("humans") == 0))


def voice_sessions(log: DataFrame, users: list[str], roles: list[str], slices: int | None = None) -> DataFrame:
    """Calls of each channel: from when the rule to join first holds until nobody is left or the channel is disarmed.

    Setting and resetting exclude each other, so the state after an event is the
    last signal so far. A call still open at the end has a null end.
    """
    on = F.col("armed") & (F.col("humans") > 0) & ((F.col("triggered") > 0) if users or roles else F.lit(True))
    off = (F.col("humans") == 0) | (F.col("action") == "disarm")
    signal = F.when(on, 1).when(off, 0)
    rows = occupancy(log, users, roles, slices).withColumn("signal", signal).select("_slice", "channel_id", *ORDER, "signal")
    rows = scan.running(rows, ["channel_id"], ORDER, {"recording": ("last", F.col("signal")), "before": ("before", F.col("signal"))})
    flips = rows.where(F.coalesce("recording", F.lit(0)) != F.coalesce("before", F.lit(0))).checkpoint()
    flips = scan.running(flips, ["channel_id"], ORDER, {"ended_at": ("next", F.col("ts")), "session": ("sum", F.col("recording"))})
    return flips.where("recording = 1").select("channel_id", F.col("session").cast("int").alias("session"), F.col("ts").alias("started_at"), "ended_at")


def armed_channels(commands: DataFrame, allowed: DataFrame, slices: int | None = None) -> DataFrame:
    """Every arm and disarm with whether it changed the channel's state, which begins as membership in ``allowed``."""
    start = allowed.select("channel_id").distinct().withColumn("_first", F.lit(True))
    orders = commands.where(F.col("action").isin("arm", "disarm")).select("channel_id", *ORDER, (F.col("action") == "arm").alias("armed"))
    rows = scan.running(scan.sliced(orders, ["channel_id"], ORDER, slices), ["channel_id"], ORDER, {"was": ("before", F.col("armed")), "later": ("next", F.col("event_id"))})
    changed = F.col("armed") != F.coalesce("was", "_first", F.lit(False))
    return rows.join(start, "channel_id", "left").select("channel_id", "event_id", "armed", changed.alias("changed"), F.col("later").isNull().alias("latest"))


def align_bursts(bursts: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Bursts with at_ms, the silence put before each (gap_ms) and the track written so far (written_ms).

    In closed form: written = sum of durations + the largest lag of a burst
    behind the sum before it.
    """
    w = Window.partitionBy(*keys).orderBy("at_ms", "burst_idx")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = bursts.withColumns({"_s": F.sum("dur_ms").over(run), "_t0": F.first("at_ms").over(run)})
    rows = rows.withColumn("_lag", F.col("at_ms") - F.col("_t0") - (F.col("_s") - F.col("dur_ms")))
    rows = rows.withColumn("written_ms", F.col("_s") + F.max("_lag").over(run))
    gap = F.col("written_ms") - F.col("dur_ms") - F.coalesce(F.lag("written_ms").over(w), F.lit(0))
    return rows.withColumn("gap_ms", gap).drop("_s", "_t0", "_lag")


def track_totals(bursts: DataFrame, call_start_ms: Column, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Of each track: its start in the call and its length with the silences."""
    return align_bursts(bursts, keys).groupBy(*keys).agg(F.greatest(F.lit(0).cast("long"), F.min("at_ms") - F.first(call_start_ms)).alias("start_offset_ms"), F.max("written_ms").alias("duration_ms"), F.count("*").alias("n_bursts"))


def burst_sessions(bursts: DataFrame, silence_ms: int = 1000, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Utterances: bursts with less than ``silence_ms`` between one's start and the end of all before."""
    w = Window.partitionBy(*keys).orderBy("at_ms", "burst_idx")
    end = F.max(F.col("at_ms") + F.col("dur_ms")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = bursts.withColumn("_end", end).withColumn("_new", (F.col("_end").isNull() | (F.col("at_ms") - F.col("_end") >= silence_ms)).cast("int"))
    rows = rows.withColumn("utterance", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "utterance").agg(F.min("at_ms").alias("start_ms"), F.max(F.col("at_ms") + F.col("dur_ms")).alias("end_ms"), F.count("*").alias("n_bursts"))
