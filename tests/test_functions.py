"""Scalar functions, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_lengths_and_trimming(spark):
    got = one(spark, tokens=T.estimate_tokens(F.lit("abcde")), empty=T.estimate_tokens(F.lit("")), trimmed=T.ws_trim(F.lit("﻿  a b\t ")), blank=T.is_blank(F.lit("  \n")), null=T.is_blank(F.lit(None).cast("string")))
    assert got == {"tokens": 2, "empty": 0, "trimmed": "a b", "blank": True, "null": True}


def test_rounding_is_half_up_and_never_negative(spark):
    got = one(spark, half=T.seconds_to_ms(F.lit(0.0025)), low=T.seconds_to_ms(F.lit(-3.0)), code=T.format_timecode(F.lit(6_005_000)), small=T.format_timecode(F.lit(61_000)))
    assert got == {"half": 3, "low": 0, "code": "100:05", "small": "01:01"}


def test_code_fence(spark):
    fenced = one(spark, a=T.strip_code_fence(F.lit("```json\n{\"a\": 1}\n```")), b=T.strip_code_fence(F.lit(" {} ")), c=T.strip_code_fence(F.lit("```\n{}```")))
    assert fenced["a"] == '{"a": 1}' and fenced["b"] == "{}"


@pytest.mark.parametrize(("kind", "name", "expected"), [("image/png", "x.txt", True), ("application/octet-stream", "x.mp4", False), (None, "x.MP4", True), (None, "noext", False), (None, None, False), ("", "x.webp", True), (None, "x.svg", False)])
def test_content_type_overrides_the_ending(spark, kind, name, expected):
    assert one(spark, m=T.is_media(F.lit(kind).cast("string"), F.lit(name).cast("string")))["m"] is expected


@pytest.mark.parametrize(("status", "expected"), [(400, True), (408, False), (429, False), (404, True), (500, False), (200, False)])
def test_permanent_rejections(spark, status, expected):
    assert one(spark, p=T.is_permanent_rejection(F.lit(status)))["p"] is expected


def pack(costs, most):
    out, n, chunk = [], 0, -1
    for c in costs:
        if chunk < 0 or n + c > most:
            chunk, n = chunk + 1, 0
        n += c
        out.append(chunk)
    return out


def test_packing_equals_a_loop(spark):
    rng = random.Random(1)
    lists = [[3, 3, 3, 9, 1, 1], [], *([rng.randint(1, 9) for _ in range(rng.randint(1, 30))] for _ in range(50))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>").select("i", T.packed(F.col("x"), 7).alias("p"))
    got = dict(df.collect())
    assert all(got[i] == pack(x, 7) for i, x in enumerate(lists)) and got[0] == [0, 0, 1, 2, 3, 3]


def split(text, limit):
    parts, cur = [], ""
    for line in text.split("\n"):
        if len(line) > limit:
            if cur:
                parts.append(cur)
            parts += [line[i : i + limit] for i in range(0, len(line), limit)]
            cur = ""
        elif not cur:
            cur = line
        elif len(cur) + 1 + len(line) <= limit:
            cur += "\n" + line
        else:
            parts.append(cur)
            cur = line
    return [*parts, cur] if cur else parts


def test_splitting_equals_a_loop(spark):
    rng = random.Random(2)
    texts = ["\n".join("x" * rng.choice([0, 1, 3, 9, 25]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.split_lines(F.col("t"), 10).alias("p"))
    assert all(p == split(texts[i], 10) for i, p in df.collect())


def test_rendering(spark):
    items = F.array(F.struct(F.lit("Ada").alias("owner"), F.lit("write").alias("item")))
    got = one(spark, none=T.bullet_list(F.array().cast("array<string>")), items=T.action_item_list(items), notes=T.join_notes(F.array(F.lit("a"), F.lit("b"))), foot=T.honesty_footer(F.lit(None).cast("boolean"), F.lit("x")), cut=T.truncate_ellipsis(F.lit("abcdef"), 4))
    assert got == {"none": "_None._", "items": "- **Ada:** write", "notes": "--- Notes 1 ---\na\n\n--- Notes 2 ---\nb", "foot": "-# mode=fused | termination=x", "cut": "abc…"}


def test_reply_without_memories(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, r=T.render_reply(F.lit("q"), empty, empty, F.lit("-# mode=fused")))["r"] == "**Q:** q\n\nNo memories matched.\n-# mode=fused"


def test_reply_with_memories(spark):
    foot = T.honesty_footer(F.lit(False), F.lit("term_cond"))
    got = one(spark, r=T.render_reply(F.lit("q"), F.array(F.lit(" one "), F.lit("y" * 500)), F.array(F.lit("ref")), foot))["r"]
    assert got == "**Q:** q\n\n**1.** one\n-# ref\n\n**2.** " + "y" * 399 + "…\n-# unknown source\n\n-# mode=fused | graph_censored=false | termination=term_cond"


def test_summary_markdown(spark):
    from colloquy.operators import summary as S
    from colloquy.sources import contracts as C

    item = '{"owner": "Ada", "item": "write"}'
    speaker = '{"displayName": "Ada", "contributions": ["spoke"], "positionsConcerns": [], "actionItems": [%s]}' % item
    body = '{"fullCall": {"overview": " ", "keyTopics": ["a", "b"], "decisions": [], "openQuestions": [], "actionItems": [%s]}, "perSpeaker": [%s]}'
    parsed = lambda s: C.parsed(C.SUMMARY, F.parse_json(F.lit(s)))
    got = one(spark, full=S.render_summary_md(parsed(body % (item, speaker)), F.lit("v.mkv")), bare=S.render_summary_md(parsed(body % ("", "")), F.lit(None).cast("string")))
    head = "\n\n## Overview\n_No overview._\n\n## Key topics\n- a\n- b\n\n## Decisions\n_None._\n\n## Open questions\n_None._\n\n## Action items\n"
    assert got["full"] == "# Call summary\n\n📹 Video recorded (aligned) — v.mkv" + head + "- **Ada:** write\n\n## Per-speaker\n\n### Ada\n**Contributions**\n- spoke\n**Positions / concerns**\n_None._\n**Action items**\n- **Ada:** write"
    assert got["bare"] == "# Call summary" + head + "_None._\n\n## Per-speaker\n_No per-speaker breakdown._"


def test_issues_without_a_path(spark):
    from colloquy.sources import validate

    got = one(spark, e=validate.format_issues(validate.issues(("", F.lit(True), "not an object"), ("a.b", F.lit(True), "empty"), ("c", F.lit(False), "x"))))
    assert got["e"] == "not an object; a.b: empty"
