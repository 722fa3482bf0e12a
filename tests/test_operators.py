"""Operators on small tables: the cases that the rules turn on."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from colloquy.operators import graph as G
from colloquy.operators import lifecycle as L
from colloquy.operators import messages as M
from colloquy.operators import recall as R
from colloquy.operators import summary as S
from colloquy.operators import transcript as C
from colloquy.operators import voice as V
from colloquy.sources import contracts as D
from colloquy.sources import io, validate


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture
def call(spark):
    tracks = spark.createDataFrame([("c", "a", "Ada", 0, 1000), ("c", "e", "Eve", 1, 0)], "call_id string, user_id string, display_name string, track_idx int, start_offset_ms bigint")
    segs = spark.createDataFrame([("c", "a", 0, 0, 10, "hi"), ("c", "e", 0, 1000, 1010, "yo"), ("c", "a", 1, 500, 600, "  "), ("c", "e", 1, 0, 5, "first")], "call_id string, user_id string, seg_idx int, start_ms bigint, end_ms bigint, text string")
    return tracks, segs


def test_timeline_shifts_drops_blanks_and_breaks_ties(call):
    tracks, segs = call
    merged = C.timeline(C.label_segments(segs, tracks))
    assert rows(merged, "pos", "speaker", "text") == [(0, "Eve", "first"), (1, "Ada", "hi"), (2, "Eve", "yo")]
    assert C.render_transcript(merged).first()["transcript"] == "Eve: first\nAda: hi\nEve: yo"
    assert [r["text"] for r in C.group_by_speaker(merged).orderBy("speaker_idx").collect()] == ["first\nyo", "hi"]


def test_scrub_allows_unknown_names_and_takes_the_last_track(spark, call):
    tracks, segs = call
    merged = C.timeline(C.label_segments(segs, tracks))
    stranger = merged.withColumn("speaker", F.when(F.col("speaker") == "Ada", "Nobody").otherwise(F.col("speaker")))
    out = spark.createDataFrame([("e",)], "user_id string")
    assert {r["speaker"] for r in C.scrub_segments(stranger, tracks, out).collect()} == {"Nobody"}


def test_digest_keeps_silent_calls(spark, call):
    tracks, segs = call
    calls = spark.createDataFrame([("c",), ("quiet",)], "call_id string")
    got = {r["call_id"]: r for r in C.call_digest(calls, C.label_segments(segs, tracks), tracks, spark.createDataFrame([], "user_id string")).collect()}
    assert got["quiet"]["strategy"] == "silent" and got["quiet"]["tokens"] == 0 and got["c"]["n_segments"] == 3 and got["c"]["strategy"] == "single"


def test_stt_falls_back_to_the_whole_file(spark):
    docs = [("a", json.dumps({"text": " all ", "duration": 2.0})), ("b", json.dumps({"text": "x", "segments": [{"start": 0.5, "end": 1.0, "text": " s "}, {"start": 1, "end": 2, "text": " "}]})), ("c", json.dumps({"text": "  "}))]
    got = C.stt_to_segments(spark.createDataFrame(docs, "call_id string, stt string"))
    assert rows(got, "call_id", "start_ms", "end_ms", "text") == [("a", 0, 2000, "all"), ("b", 500, 1000, "s")]


def cost(parts):
    return -(-(sum(map(len, parts)) + sum(len(f"--- Notes {i + 1} ---\n") for i in range(len(parts))) + 2 * (len(parts) - 1)) // 4)


def test_note_batches_equal_a_loop_and_fold_ends(spark):
    rng = random.Random(3)
    notes = ["x" * rng.randint(1, 200) for _ in range(60)]
    got = {r["note_idx"]: r["batch"] for r in C.batch_notes(spark.createDataFrame([("c", i, n) for i, n in enumerate(notes)], "call_id string, note_idx int, note string"), 100).collect()}
    batch, current = 0, []
    for i, n in enumerate(notes):
        if current and cost([*current, n]) > 100:
            batch, current = batch + 1, []
        current.append(n)
        assert got[i] == batch
    folded = C.fold_notes(spark.createDataFrame([("c", i, n) for i, n in enumerate(notes)] + [("d", 0, "only")], "call_id string, note_idx int, note string"), 500).collect()
    assert {r["call_id"] for r in folded} == {"c", "d"}


def joined(parts):
    return "\n\n".join(f"--- Notes {i + 1} ---\n{p}" for i, p in enumerate(parts))


@pytest.mark.parametrize("over", [0, 1])
def test_a_batch_costs_what_its_joined_text_does(spark, over):
    """Ten notes joined to 640 characters, line breaks of their headers included, fit 160 tokens; with one more character they don't."""
    notes = ["x" * 40] * 9
    notes.append("x" * (640 + over - len(joined([*notes, ""]))))
    df = spark.createDataFrame([("c", i, n) for i, n in enumerate(notes)], "call_id string, note_idx int, note string")
    assert len(joined(notes)) == 640 + over
    assert {r["note_idx"]: r["batch"] for r in C.batch_notes(df, 160).collect()} == {i: over * (i == 9) for i in range(10)}


def test_fold_equals_a_loop(spark):
    rng = random.Random(5)
    calls = {f"c{k}": ["".join(rng.choices("abc ", k=rng.randint(1, 200))) for _ in range(k)] for k in (1, 3, 12, 60)}
    rows_ = [(c, i, n) for c, notes in calls.items() for i, n in enumerate(notes)]
    got = {r["call_id"]: (r["notes"], r["n_notes"]) for r in C.fold_notes(spark.createDataFrame(rows_, "call_id string, note_idx int, note string"), 160).collect()}
    for call, notes in calls.items():
        while True:
            batches = []
            for n in notes:
                if batches and cost([*batches[-1], n]) <= 160:
                    batches[-1].append(n)
                else:
                    batches.append([n])
            if not 1 < len(batches) < len(notes):
                break
            notes = [joined(b)[:800] for b in batches]
        assert got[call] == (joined(notes), len(notes))


def test_mentions_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([("m1", ["a", "b", "a"]), ("m1", ["b"]), ("m1", ["c"]), ("m2", None), ("m3", [])], "message_id string, mentions array<string>")
    out = M.scrub_mentions(df, spark.createDataFrame([("b",), ("b",), ("z",)], "user_id string"))
    assert sorted((r["message_id"], r["mentions"]) for r in out.collect()) == [("m1", []), ("m1", ["a", "a"]), ("m1", ["c"]), ("m2", []), ("m3", [])]


def test_history_goes_on_from_its_cursors(spark):
    df = spark.createDataFrame([(c, i) for c in ("a", "b") for i in range(25)], "channel_id string, seq int")
    first = M.history_pages(df, size=10).where("page < 2")
    cursors = M.next_cursors(first)
    rest = M.history_pages(df, cursors, 10)
    assert sorted((r["channel_id"], r["seq"], r["page"], r["page_pos"]) for r in rest.collect()) == [(c, i, 0, 5 - i) for c in ("a", "b") for i in range(5)]
    assert M.history_pages(df, cursors.where("channel_id = 'a'"), 10).count() == 5
    top = M.keyset_page(df, spark.createDataFrame([("a", None), ("b", 3)], "channel_id string, before int"), 2)
    assert sorted((r["channel_id"], r["seq"]) for r in top.collect()) == [("a", 23), ("a", 24), ("b", 1), ("b", 2)]


def test_bursts_equal_a_loop(spark):
    rng = random.Random(4)
    data, at = [], 0
    for i in range(40):
        at += rng.randint(0, 30)
        data.append(("u", i, at, rng.randint(1, 40)))
    got = {r["burst_idx"]: (r["gap_ms"], r["written_ms"]) for r in V.align_bursts(spark.createDataFrame(data, "user_id string, burst_idx int, at_ms bigint, dur_ms bigint")).collect()}
    written = 0
    for _, i, t, dur in data:
        gap = max(0, t - data[0][2] - written)
        written += gap + dur
        assert got[i] == (gap, written)


def test_voice_rule_ignores_repeated_joins_and_bots(spark):
    log = spark.createDataFrame([(1, 1, "v", "u1", False, "r", "arm"), (2, 2, "v", "b", True, "r", "join"), (3, 3, "v", "u1", False, "r", "join"), (4, 4, "v", "u1", False, "r", "join"), (5, 5, "v", "u1", False, "r", "leave"), (6, 6, "v", "u2", False, "r", "join")], "event_id int, ts int, channel_id string, user_id string, is_bot boolean, role_id string, action string")
    assert [(r["started_at"], r["ended_at"]) for r in V.voice_sessions(log, [], []).orderBy("started_at").collect()] == [(3, 5), (6, None)]
    assert [(r["started_at"], r["ended_at"]) for r in V.voice_sessions(log, ["u1"], []).collect()] == [(3, 5)]


def test_purge_and_reclaim_at_their_limits(spark):
    status = spark.sql("SELECT * FROM VALUES ('a', 'transcribing', timestamp_ntz'2024-01-01 00:00:00'), ('b', 'transcribing', timestamp_ntz'2024-01-01 00:00:01'), ('c', 'failed', timestamp_ntz'2020-01-01 00:00:00') AS t(call_id, status, updated_at)").withColumns({"thread_id": F.lit(None).cast("string"), "emailed_at": F.lit(None).cast("timestamp_ntz")})
    assert rows(L.reclaim_stale(status, "2024-01-01 00:15:00"), "call_id") == [("a",)]
    calls = status.withColumns({"status": F.lit("delivered"), "started_at": F.col("updated_at"), "ended_at": F.lit(None).cast("timestamp_ntz"), "has_video": F.lit(False)})
    assert rows(L.expired(calls, "2024-01-11 00:00:00", 10), "call_id") == [("a",), ("c",)]
    assert L.expired(calls, "2024-01-11 00:00:00", -1).count() == 0 and L.expired(calls, "2024-01-11 00:00:00", 10, video=True).count() == 0


def test_outbox_stops_at_the_first_transient_failure(spark):
    box = spark.createDataFrame([("p", 1, 200), ("p", 2, 400), ("p", 3, 429), ("p", 4, 200), ("q", 1, 404)], "producer string, pos int, http_status int")
    assert rows(L.delivery_outcomes(box), "producer", "pos", "outcome") == [("p", 1, "delivered"), ("p", 2, "parked"), ("p", 3, "pending"), ("p", 4, "pending"), ("q", 1, "parked")]


def summary(**over):
    full = {"overview": "o", "keyTopics": ["t"], "decisions": [], "openQuestions": [], "actionItems": [{"owner": "Ada", "item": "i"}]}
    return json.dumps({"fullCall": full | over, "perSpeaker": [{"displayName": "Ada", "contributions": ["x"], "positionsConcerns": [], "actionItems": []}]})


@pytest.mark.parametrize(("raw", "good"), [(summary(), True), (f"```json\n{summary()}\n```", True), (summary(overview=5), False), (summary(keyTopics=[1]), False), (summary(actionItems=[{"item": "i"}]), False), (summary(actionItems=[{"owner": "", "item": "i"}]), False), ("{", False), (None, False), ("[]", False)])
def test_summaries_are_strict(spark, raw, good):
    df = spark.createDataFrame([("c", raw)], "call_id string, raw string")
    valid, bad = S.validated(df)
    assert (valid.count(), bad.count()) == ((1, 0) if good else (0, 1))


def test_one_repair(spark):
    df = spark.createDataFrame([("a", "Sure: " + summary() + " done"), ("b", "nothing")], "call_id string, raw string")
    good, bad = S.validate_with_repair(df)
    assert rows(good, "call_id") == [("a",)] and rows(bad, "call_id") == [("b",)]


def test_consent_gates(spark):
    df = spark.createDataFrame([("m1", "c1", "u1"), ("m2", "c2", "u1"), ("m3", "c1", "u2"), ("m4", "c2", "u2")], "message_id string, channel_id string, author_id string")
    channels, out = spark.createDataFrame([("c1",)], "channel_id string"), spark.createDataFrame([("u2",)], "user_id string")
    got = {r["message_id"]: r["skip_reason"] for r in M.gate_with_reason(df, channels, out).collect()}
    assert got == {"m1": None, "m2": "channel-not-allowed", "m3": "author-opted-out", "m4": "channel-not-allowed"}
    assert M.gate_channel(df, channels, allow_all=True).count() == 4


def test_consent_file(spark, tmp_path):
    missing = io.consent_source(spark, str(tmp_path / "none.json"))
    assert missing[0].count() == 0 and missing[2] is False
    (tmp_path / "c.json").write_text('{"allowChannels": ["c1"]}')
    assert io.consent_source(spark, str(tmp_path / "c.json"))[0].count() == 1
    (tmp_path / "bad.json").write_text('{"allowChannels": "c1"}')
    (tmp_path / "empty.json").write_text('{"optOutMembers": [""]}')
    for name in ("bad", "empty"):
        with pytest.raises(ValueError):
            io.consent_source(spark, str(tmp_path / f"{name}.json"))


MANIFEST = {
    "callId": "2024-03-01T10-00-00-000Z--77", "guildId": "g1", "channelId": "77", "startedAt": "2024-03-01T10:00:00.000Z", "endedAt": "2024-03-01T10:30:00.250Z",
    "tracks": [{"userId": "u1", "displayName": "Ada", "path": "audio/u1.pcm", "startOffsetMs": 0}, {"userId": "u2", "displayName": "Bo", "path": "audio/u2.pcm", "startOffsetMs": 1500}],
    "video": {"path": "video.mp4", "startedAt": "2024-03-01T09:59:58.000Z", "startOffsetMs": -2000},
}
STATUS = {"callId": "a", "status": "failed", "updatedAt": "2024-03-01T10:31:00.000Z", "error": "no audio", "threadId": "99"}


def folder(base, name, **files):
    (base / name / "audio").mkdir(parents=True)
    for file, body in files.items():
        (base / name / file.replace("_", ".")).write_text(body if isinstance(body, str) else json.dumps(body, indent=2))


def test_call_folders_are_read_as_they_lie(spark, tmp_path):
    running = {**{k: v for k, v in MANIFEST.items() if k != "video"}, "callId": "b", "endedAt": None, "tracks": []}
    transcript = {"callId": "a", "segments": [{"speaker": "Ada", "startMs": 0, "endMs": 900, "text": "hi"}, {"speaker": "Bo", "startMs": 800, "endMs": 800, "text": ""}]}
    folder(tmp_path, "a", manifest_json=MANIFEST, status_json=STATUS, transcript_json=transcript, summary_json=summary(), summary_md="# x")
    folder(tmp_path, "b", manifest_json=running, status_json="{ half")
    folder(tmp_path, "c", status_json={**STATUS, "emailedAt": "2024-03-01T12:00:00+02:00"})
    good, bad = io.scan_calls(spark, str(tmp_path))
    got = {r.call_id: r for r in good.collect()}
    a = got[MANIFEST["callId"]]
    assert set(got) == {a.call_id, "b"} and bad.count() == 0
    assert good.schema["started_at"].dataType.typeName() == "timestamp" and (a.ended_at - a.started_at).total_seconds() == 1800.25
    assert [(t.user_id, t.start_offset_ms) for t in a.tracks] == [("u1", 0), ("u2", 1500)] and a.video.start_offset_ms == -2000
    assert got["b"].ended_at is None and got["b"].video is None and got["b"].tracks == []
    good, bad = io.scan_status(spark, str(tmp_path))
    assert [(r.call_id, r.status, r.error, r.thread_id, r.emailed_at) for r in good.collect()] == [("a", "failed", "no audio", "99", None)]
    assert sorted(r.errors for r in bad.collect()) == ["$: not JSON", "emailedAt: not an ISO time in UTC"]
    said, bad = io.scan_transcripts(spark, str(tmp_path))
    assert [(x.speaker, x.end_ms) for x in said.first().segments] == [("Ada", 900), ("Bo", 800)] and bad.count() == 0
    told, bad = io.scan_summaries(spark, str(tmp_path))
    assert told.first().call_id == "a" and told.first().full_call.key_topics == ["t"] and bad.count() == 0
    assert io.scan_calls(spark, str(tmp_path / "absent"))[0].count() == 0


def without(doc, key):
    return {k: v for k, v in doc.items() if k != key}


def track(**over):
    return {**MANIFEST, "tracks": [MANIFEST["tracks"][0], {**MANIFEST["tracks"][1], **over}]}


MANIFEST_CASES = [
    (MANIFEST, ""), ({**MANIFEST, "more": 1}, ""), ([], "not an object"), (without(MANIFEST, "endedAt"), "endedAt: missing"), ({**MANIFEST, "video": None}, "video: not an object"),
    ({**MANIFEST, "callId": "", "guildId": 5}, "callId: empty; guildId: not a string"), ({**MANIFEST, "startedAt": "2024-13-01T10:00:00Z"}, "startedAt: not an ISO time in UTC"),
    (track(userId=""), "tracks.1.userId: empty"), (track(startOffsetMs=-1), "tracks.1.startOffsetMs: negative"), (track(startOffsetMs=1.5), "tracks.1.startOffsetMs: not a whole number"), (track(startOffsetMs="1"), "tracks.1.startOffsetMs: not a number"),
    (track(startOffsetMs=2.0), ""), ({**MANIFEST, "tracks": {}}, "tracks: not an array"), ({**MANIFEST, "tracks": [None, 5]}, "tracks.0: not an object; tracks.1: not an object"),
    ({**MANIFEST, "video": {"path": "v", "startedAt": "x"}}, "video.startedAt: not an ISO time in UTC; video.startOffsetMs: missing"),
]
OTHER_CASES = [
    ("STATUS", STATUS, ""), ("STATUS", {**STATUS, "callId": ""}, "callId: empty"), ("STATUS", {**STATUS, "error": None}, "error: not a string"),
    ("STATUS", {**STATUS, "status": "done"}, "status: not one of recording, ready-to-process, transcribing, summarizing, delivered, failed"),
    ("SEGMENT", {"speaker": "A", "startMs": 5, "endMs": 4, "text": ""}, "endMs: before startMs"), ("SEGMENT", {"speaker": "", "startMs": 5, "endMs": 4, "text": ""}, "speaker: empty"),
    ("SUMMARY", json.loads(summary(actionItems=[{"owner": "A", "item": ""}, {"owner": "", "item": "x"}])), "fullCall.actionItems.0.item: empty; fullCall.actionItems.1.owner: empty"),
]


def test_errors_name_the_element(spark):
    cases = [("MANIFEST", doc, errors) for doc, errors in MANIFEST_CASES] + OTHER_CASES
    for contract in ("MANIFEST", "STATUS", "SEGMENT", "SUMMARY"):
        mine = [(i, json.dumps(doc)) for i, (c, doc, _) in enumerate(cases) if c == contract]
        got = spark.createDataFrame(mine, "i int, d string").select("i", io.document_errors(getattr(D, contract), F.try_parse_json("d")).alias("e")).collect()
        assert [(r.i, r.e) for r in got] == [(i, cases[i][2]) for i, _ in mine]


@pytest.mark.parametrize(("contract", "doc"), [("MANIFEST", MANIFEST), ("MANIFEST", {**without(MANIFEST, "video"), "endedAt": None}), ("STATUS", STATUS), ("SUMMARY", json.loads(summary(overview='a "b" \\ é\n')))])
def test_what_is_read_is_written_as_it_was(spark, contract, doc):
    c = getattr(D, contract)
    df = spark.createDataFrame([(json.dumps(doc),)], "d string").select(D.parsed(c, F.try_parse_json("d")).alias("x"))
    assert df.schema["x"].dataType.simpleString() == D.ddl(c)
    text = df.select(D.written(c, F.col("x"))).first()[0]
    want = {**doc, "endedAt": doc["endedAt"]} if contract == "MANIFEST" else doc
    assert json.loads(text) == want and list(json.loads(text)) == list(want)


def test_a_call_leaves_as_two_events(spark):
    """Eve opted out: her segment, section and ownership go; a name without a track is nobody's."""
    merged = spark.createDataFrame([("a", 0, "Ada", 0, 1000, "one"), ("a", 1, "Eve", 1000, 2000, "two"), ("a", 2, "Guest", 2000, 3000, "three")], "call_id string, pos int, speaker string, start_ms long, end_ms long, text string")
    tracks = spark.createDataFrame([("a", "u1", "Ada", 0, 0), ("a", "u2", "Eve", 1, 0)], "call_id string, user_id string, display_name string, track_idx int, start_offset_ms int")
    body = json.loads(summary(overview="  ", actionItems=[{"owner": "Eve", "item": "x"}, {"owner": "Ada", "item": "y"}]))
    body["perSpeaker"] += [{**body["perSpeaker"][0], "displayName": "Eve"}]
    told = S.validated(spark.createDataFrame([("a", json.dumps(body))], "call_id string, raw string"))[0]
    calls = spark.createDataFrame([("a", "voice"), ("b", "other")], "call_id string, channel_id string")
    allowed, out = spark.createDataFrame([("voice",)], "channel_id string"), spark.createDataFrame([("u2",)], "user_id string")
    got = {r.event_type: r.event for r in S.output_events(merged, told, tracks, calls, allowed, out).collect()}
    assert got["transcript"] == '{"type":"transcript","call_id":"a","channel_id":"voice","segments":[{"speaker":"Ada","startMs":0,"endMs":1000,"text":"one"},{"speaker":"Guest","startMs":2000,"endMs":3000,"text":"three"}],"region":"discord"}'
    assert got["summary"] == ('{"type":"summary","call_id":"a","summary":{"fullCall":{"overview":"Call a","keyTopics":["t"],"decisions":[],"openQuestions":[],"actionItems":[{"owner":"unassigned","item":"x"},{"owner":"Ada","item":"y"}]},'
                              '"perSpeaker":[{"displayName":"Ada","contributions":["x"],"positionsConcerns":[],"actionItems":[]}]},"region":"discord"}')


RAW = "message_id string, seq long, guild_id string, raw_channel_id string, parent_id string, author_id string, author_is_bot boolean, is_system boolean, is_partial boolean, member_name string, username string, kind string, content string, ts timestamp, reply_to string, mentions array<string>, attachments array<struct<id:string,url:string,filename:string,content_type:string>>"


def message(**over):
    base = {"message_id": "m1", "seq": 1, "guild_id": "g1", "raw_channel_id": "c1", "parent_id": None, "author_id": "u1", "author_is_bot": False, "is_system": False, "is_partial": False, "member_name": "Ada", "username": "ada",
            "kind": "create", "content": "a plan", "ts": datetime(2026, 7, 20, 12), "reply_to": None, "mentions": [], "attachments": []}
    return tuple((base | over).values())


def sent(spark, *messages, members=False):
    allowed, out = spark.createDataFrame([("c1",)], "channel_id string"), spark.createDataFrame([("u9",)], "user_id string")
    return [r.event for r in M.ingest(spark.createDataFrame(list(messages), RAW), allowed, out, members=members).orderBy("event_type", "event_key").collect()]


def test_events_of_messages_as_they_are_sent(spark):
    file = lambda i, name, kind: (i, "https://f/" + i, name, kind)
    thread = message(raw_channel_id="t7", parent_id="c1", reply_to="m0", mentions=["u9", "u2", "u9", "u3"], attachments=[file("a1", "x.mp4", None), file("a2", "x.txt", None), file("a3", "x", "image/png")])
    assert sent(spark, thread) == [
        '{"type":"media","media_id":"a1","url":"https://f/a1","filename":"x.mp4","channel_id":"c1","message_id":"m1","region":"discord"}',
        '{"type":"media","media_id":"a3","url":"https://f/a3","filename":"x","content_type":"image/png","channel_id":"c1","message_id":"m1","region":"discord"}',
        '{"type":"message","message_id":"m1","channel_id":"c1","author_id":"u1","author_name":"Ada","content":"a plan","guild_id":"g1","thread_id":"t7","reply_to":"m0","mentions":["u2","u3"],"edited":false,"timestamp":"2026-07-20T12:00:00.000Z","region":"discord"}']
    assert sent(spark, message(kind="edit", member_name=None), members=True) == [
        '{"type":"member","member_id":"u1","display_name":"ada","region":"discord"}',
        '{"type":"message","message_id":"m1","channel_id":"c1","author_id":"u1","author_name":"ada","content":"a plan","guild_id":"g1","mentions":[],"edited":true,"timestamp":"2026-07-20T12:00:00.000Z","region":"discord"}']
    # an attachment alone, a channel and an author without consent, a direct message, and a delete, which is never held back
    assert len(sent(spark, message(content=" ", attachments=[file("a1", "x.png", "")]))) == 1
    assert sent(spark, message(raw_channel_id="c2"), message(author_id="u9"), message(guild_id=None)) == []
    assert sent(spark, message(kind="delete", raw_channel_id="c2", author_id="u9", is_partial=True, mentions=None)) == ['{"type":"tombstone-request","target":"discord://channel/c2/message/m1","reason":"discord message deleted"}']


def test_sink_looks_into_the_slots_it_touches_alone(spark, tmp_path):
    """Files of other slots are spoilt: whatever read them would fail."""
    from pathlib import Path

    path = str(tmp_path / "t")
    df = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("event_key"), F.col("id").alias("event_id"), M.slot(F.concat(F.lit("m"), "id"), 10).alias("slot"))
    for lo in range(0, 100, 10):
        io.sink_events_idempotent(df(lo, lo + 10), path, ["event_id"], within="slot")
    kept = {}
    for f in Path(path).glob("slot=*/*.parquet"):
        if f.parent.name != "slot=9":
            kept[f] = f.read_bytes()
            f.write_bytes(b"spoilt")
    for f in Path(path).glob("slot=*/.*.crc"):
        f.unlink()
    io.sink_events_idempotent(df(95, 100), path, ["event_id"], within="slot")
    for f, data in kept.items():
        f.write_bytes(data)
    io.sink_events_idempotent(df(0, 105), path, ["event_id"], within="slot")
    assert spark.read.parquet(path).count() == 105


def test_sink_twice_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "event_key string, event_id int")
    for _ in range(2):
        io.sink_events_idempotent(df, str(tmp_path / "t"), ["event_id"])
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [("k1", 1), ("k2", 3)]


def test_neighbourhood_and_fused_recall(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src bigint, dst bigint")
    start = spark.createDataFrame([(1, 1)], "query bigint, node bigint")
    assert rows(G.neighbourhood(edges, start, 2), "node", "hop") == [(1, 0), (2, 1), (3, 2)]
    assert G.neighbourhood(edges, start, 2, 0).where("censored").count() == 1
    mem = spark.createDataFrame([(i, [float(i), 1.0], "r") for i in range(1, 6)], "memory_id bigint, embedding array<float>, region string")
    got = R.recall_fused(mem.where("memory_id = 1"), mem, edges, 3)
    assert got.count() > 0 and set(got.columns) >= {"graph_censored", "termination_reason", "score"}


@pytest.mark.parametrize("region", [False, True])
def test_recall_in_chunks_and_blocks_equals_scores_of_all_pairs(spark, monkeypatch, region):
    """Equal scores, copies, vectors of another length and null ones: the ranking is that of every pair scored in SQL."""
    monkeypatch.setattr(R, "QUERY_CHUNK", 7)
    monkeypatch.setattr(R, "MEMORY_BLOCK", 60)
    rng = random.Random(4)
    data = [(i, [float(rng.randint(-2, 2)) for _ in range(3)] if i % 3 else [1.0, 2.0, 3.0], rng.choice("xyz")) for i in range(400)]
    data = [(i, [*v[:2], 9.0] if not any(v) else v, r) for i, v, r in data] + [(400, None, "x"), (401, [1.0, None, 2.0], "y"), (402, [1.0, 2.0], "x"), (403, [float("nan"), 1.0, 1.0], "z")]
    mem = spark.createDataFrame(data, "memory_id bigint, embedding array<float>, region string")
    queries = mem.where("memory_id % 20 = 0 OR memory_id > 400")
    want = R.top(R._scored(queries, mem, region), 5)
    shown = lambda df: sorted(map(str, df.select("query", "rank", "memory_id", "score").collect()))
    assert shown(R.recall_vector(queries, mem, 5, region)) == shown(want)
    plan = R.recall_vector(queries.where("memory_id < 400"), mem.where("memory_id < 400"), 5, region)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_issues_line(spark):
    got = spark.range(1).select(validate.format_issues(validate.issues(("a", F.lit(True), "x"), ("b", F.lit(None).cast("boolean"), "y"), ("c", F.lit(True), "z"))).alias("e")).first()["e"]
    assert got == "a: x; c: z"


def test_no_running_value_looks_at_the_rest_of_its_slice_for_every_row(spark):
    from colloquy.operators import scan

    rows = spark.range(9).selectExpr("id % 2 AS k", "id", "0 AS _slice")
    plan = scan.running(rows, ["k"], ["id"], {"s": ("sum", F.col("id")), "b": ("before", F.col("id")), "n": ("next", F.col("id"))})
    assert "unboundedfollowing" not in plan._jdf.queryExecution().toString().lower()
    assert sorted((r.id, r.n) for r in plan.collect()) == [(i, i + 2 if i < 7 else None) for i in range(9)]


def test_running_values_are_the_same_in_any_number_of_slices(spark):
    from pyspark.sql import Window

    from colloquy.operators import scan

    rng = random.Random(9)
    data = [(rng.choice("aaaaab"), i, rng.choice([None, None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, at int, v int").repartition(3)
    w = Window.partitionBy("k").orderBy("at")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    plain = df.select("k", "at", F.coalesce(F.sum("v").over(w.rowsBetween(start, 0)), F.lit(0)).alias("s"), F.last("v", True).over(w.rowsBetween(start, 0)).alias("l"), F.last("v", True).over(w.rowsBetween(start, -1)).alias("b"), F.first("v", True).over(w.rowsBetween(1, end)).alias("n"))
    want = sorted(map(tuple, plain.collect()))
    for n in (1, 7, 40):
        rows_ = scan.sliced(df, ["k"], ["at"], n)
        assert rows_.where("k = 'a'").select("_slice").distinct().count() >= min(n, 6)
        got = scan.running(rows_, ["k"], ["at"], {"s": ("sum", F.col("v")), "l": ("last", F.col("v")), "b": ("before", F.col("v")), "n": ("next", F.col("v"))})
        assert sorted(map(tuple, got.select("k", "at", "s", "l", "b", "n").collect())) == want


@pytest.mark.parametrize("most", [1, 7, 20])
def test_long_keys_are_packed_as_by_the_fold(spark, most):
    from colloquy.operators import packing

    rng = random.Random(most)
    data = [(k, i, rng.choice([1, 1, 2, 3, 5, 9])) for k, n in (("a", 300), ("b", 1), ("c", 40)) for i in range(n)]
    want = []
    for k in "abc":
        n = chunk = 0
        for _, i, tok in (r for r in data if r[0] == k):
            if i and n + tok > most:
                chunk, n = chunk + 1, 0
            n += tok
            want.append((k, i, tok, chunk))
    items = spark.createDataFrame(data, "k string, pos int, tok int").repartition(3)
    assert sorted(map(tuple, packing.greedy(items, most, ("k",), 9).collect())) == want


def test_notes_by_a_maker_that_fails_now_and_then(spark):
    def maker(batches):
        for pdf in batches:
            bad = pdf["text"].str.startswith("bad")
            yield pdf.assign(note=("note of " + pdf["text"]).mask(bad, None).mask(pdf["text"] == "blank", " "), failure=bad.map({True: "no answer", False: None}).astype(object))

    texts = spark.createDataFrame([("a", 0, "x" * 900), ("a", 1, "bad one"), ("a", 2, "blank"), ("b", 0, "fine")], "call_id string, chunk int, text string")
    got = {(r.call_id, r.note_idx): (r.note, r.failure) for r in C.make_notes(texts, maker).collect()}
    assert got == {("a", 0): ("note of " + "x" * 792, None), ("a", 1): ("bad one", "no answer"), ("a", 2): ("blank", None), ("b", 0): ("note of fine", None)}
    assert C.make_notes(texts).where("call_id = 'a' and note_idx = 0").first().note == "x" * 800


def test_phrases_of_common_words_are_joined_by_pairs_of_words(spark):
    """Every text has every word, each phrase one neighbour pair that a text has: no rows beyond the matches come out of the join."""
    n = 30
    docs = spark.createDataFrame([(str(i), " ".join(f"w{(i + 1) * j % 31}" for j in range(1, n + 1)) + " w0") for i in range(n)], "ref string, text string")
    phrases = spark.createDataFrame([(f"w{a} w{b}",) for a in range(31) for b in range(31) if a != b] + [("w1 w2 w3",), ("w3 w1 w2",)], "phrase string")
    texts, wanted = {r.ref: f" {r.text} " for r in docs.collect()}, [r.phrase for r in phrases.collect()]
    got = G.phrase_matches(docs, phrases)
    assert rows(got) == sorted((d, p) for d, t in texts.items() for p in wanted if f" {p} " in t)
    joined = G.phrase_keys(docs, phrases)[1]
    assert joined.where(F.size(F.split(F.trim("w"), " ")) == 2).count() == sum(f" {p} " in t for t in texts.values() for p in wanted if p.count(" ") == 1)


def test_phrases_are_found_as_whole_words(spark):
    docs = spark.createDataFrame([("a", "The New-York office, NEW YORK!"), ("b", "newyork new yorker"), ("c", "a new york"), ("d", ""), ("e", None), ("f", "été à Genève")], "ref string, text string")
    phrases = spark.createDataFrame([("New York",), ("office",), ("york new",), (" !! ",), ("ÉTÉ",), (None,)], "phrase string")
    assert rows(G.phrase_matches(docs, phrases)) == [("a", "New York"), ("a", "office"), ("c", "New York"), ("f", "ÉTÉ")]


@pytest.mark.parametrize("most", [1, 2, 200_000])
def test_words_of_texts_are_not_shuffled_to_phrases(spark, most):
    """In any number of passes, with phrases of several lengths and refs that texts share, the matches are the same, and only refs and few matches go through a shuffle."""
    docs = spark.createDataFrame([("a", "x y z"), ("a", "x y q"), ("b", "z x y z"), ("c", "y z"), (None, "x y"), (None, "y x y")], "ref string, text string")
    phrases = spark.createDataFrame([("x y",), ("y z",), ("x y z",), ("q",), ("y z y",)], "phrase string")
    got = G.phrase_matches(docs, phrases, most)
    want = {(r.ref, p.phrase) for r in docs.collect() for p in phrases.collect() if f" {p.phrase} " in f" {r.text} "}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = G.phrase_matches(docs.where("ref in ('b', 'c')"), phrases.where("phrase <> 'x y z' and phrase <> 'y z y'"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("HashAggregate") == 2  # the distinct phrases


def test_a_reader_between_the_writes_sees_the_old_version_whole(spark, tmp_path):
    path = str(tmp_path / "p")
    files = lambda v, *calls: spark.createDataFrame([(c, n, v) for c in calls for n in ("transcript.json", "summary.json", "summary.md")], "call_id string, name string, body string")
    assert io.published_artifacts(spark, path).count() == 0
    io.publish_artifacts(files("one", "a", "b"), path)
    files("half", "a").where("name = 'summary.md'").write.parquet(f"{path}/data/version=unfinished")
    assert {r.body for r in io.published_artifacts(spark, path).collect()} == {"one"}
    io.publish_artifacts(files("two", "a").where("name <> 'summary.md'"), path)
    got = sorted(map(tuple, io.published_artifacts(spark, path).collect()))
    assert got == [("a", "summary.json", "two"), ("a", "transcript.json", "two"), ("b", "summary.json", "one"), ("b", "summary.md", "one"), ("b", "transcript.json", "one")]
