"""Contracts of JSON documents and events, each declared once.

A declaration is compiled into four things: a schema (ddl), a list of issues
with the path of each element (problems), typed columns with names in snake case
(parsed), and JSON text with the document's own keys (written). Checks go over
the variant type, kind by kind: a number isn't a string, a missing key isn't
null. Keys that a contract doesn't name are let pass and not kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import STATUSES

from .validate import ISO_Z

ISSUES = "array<struct<path:string,message:string>>"


@dataclass(frozen=True)
class Text:
    """A string of at least so many characters."""

    least: int = 0


@dataclass(frozen=True)
class Moment:
    """A time in UTC, written with a Z."""


@dataclass(frozen=True)
class Whole:
    """A whole number, of at least so much."""

    least: int | None = None


@dataclass(frozen=True)
class Truth:
    """true or false."""


@dataclass(frozen=True)
class Choice:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    of: Contract


@dataclass(frozen=True)
class Maybe:
    """A key that may be absent; if it is there, it isn't null."""

    of: Contract


@dataclass(frozen=True)
class Nullable:
    """A key that has to be there, and may be null."""

    of: Contract


@dataclass(frozen=True)
class Record:
    """Fields in order, by their names in snake case. ``camel``: the document's keys are in camel case.

    ``rules`` hold between fields, once these are right: (field, field that it may not be less than, message).
    """

    fields: dict[str, Contract]
    camel: bool = True
    rules: tuple[tuple[str, str, str], ...] = ()

    def key(self, name: str) -> str:
        return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name) if self.camel else name


Contract = Text | Moment | Whole | Truth | Choice | Listed | Maybe | Nullable | Record

# The fields of documents and events.
TRACK = Record({"user_id": Text(1), "display_name": Text(1), "path": Text(1), "start_offset_ms": Whole(0)})
VIDEO = Record({"path": Text(1), "started_at": Moment(), "start_offset_ms": Whole()})
MANIFEST = Record({"call_id": Text(1), "guild_id": Text(1), "channel_id": Text(1), "started_at": Moment(), "ended_at": Nullable(Moment()), "tracks": Listed(TRACK), "video": Maybe(VIDEO)})
STATUS = Record({"call_id": Text(1), "status": Choice(tuple(STATUSES)), "updated_at": Moment(), "error": Maybe(Text()), "thread_id": Maybe(Text()), "emailed_at": Maybe(Moment())})
SEGMENT = Record({"speaker": Text(1), "start_ms": Whole(0), "end_ms": Whole(0), "text": Text()}, rules=(("end_ms", "start_ms", "before startMs"),))
TRANSCRIPT = Record({"call_id": Text(1), "segments": Listed(SEGMENT)})
ITEM = Record({"owner": Text(1), "item": Text(1)})
FULL_CALL = Record({"overview": Text(), "key_topics": Listed(Text()), "decisions": Listed(Text()), "open_questions": Listed(Text()), "action_items": Listed(ITEM)})
SPEAKER = Record({"display_name": Text(1), "contributions": Listed(Text()), "positions_concerns": Listed(Text()), "action_items": Listed(ITEM)})
SUMMARY = Record({"full_call": FULL_CALL, "per_speaker": Listed(SPEAKER)})

#: What is sent to the memory store, by type; keys are in snake case as they are sent.
_REGION = {"region": Text(1)}
EVENTS = {
    "message": Record({"type": Text(1), "message_id": Text(1), "channel_id": Text(1), "author_id": Text(1), "author_name": Text(1), "content": Text(1), "guild_id": Text(1), "thread_id": Maybe(Text(1)), "reply_to": Maybe(Text(1)), "mentions": Listed(Text(1)), "edited": Truth(), "timestamp": Moment(), **_REGION}, camel=False),
    "media": Record({"type": Text(1), "media_id": Text(1), "url": Text(1), "filename": Text(1), "content_type": Maybe(Text()), "channel_id": Text(1), "message_id": Text(1), **_REGION}, camel=False),
    "member": Record({"type": Text(1), "member_id": Text(1), "display_name": Text(1), **_REGION}, camel=False),
    "transcript": Record({"type": Text(1), "call_id": Text(1), "channel_id": Text(1), "segments": Listed(SEGMENT), **_REGION}, camel=False),
    "summary": Record({"type": Text(1), "call_id": Text(1), "summary": SUMMARY, **_REGION}, camel=False),
    "tombstone-request": Record({"type": Text(1), "target": Text(1), "reason": Text(1)}, camel=False),
}


def ddl(c: Contract) -> str:
    """The Spark type of what parsed() gives."""
    match c:
        case Whole():
            return "bigint"
        case Truth():
            return "boolean"
        case Moment():
            return "timestamp"
        case Listed():
            return f"array<{ddl(c.of)}>"
        case Maybe() | Nullable():
            return ddl(c.of)
        case Record():
            return "struct<" + ",".join(f"{name}:{ddl(x)}" for name, x in c.fields.items()) + ">"
    return "string"


def _say(path: str, message: str) -> str:
    return f"array(named_struct('path', {path}, 'message', '{message}'))"


def _under(path: str, key: str) -> str:
    """SQL of a path one key further on."""
    return key if path == "''" else f"concat({path}, '.', {key})"


def _members(c: Record) -> str:
    """The type that an object is cast to at once: its fields as variants, null where absent."""
    return "struct<" + ",".join(f"`{c.key(n)}`:variant" for n in c.fields) + ">"


def _checks(c: Contract, x: str, path: str, depth: int = 0) -> str:
    """SQL of the issues of the variant ``x``, null where absent; ``path`` is SQL of how it is called in them.

    Objects and arrays are taken apart once, from the outside in, so that the
    work of a document is in proportion to its size.
    """
    none, say = f"cast(array() AS {ISSUES})", lambda message: _say(path, message)
    if isinstance(c, Maybe):
        return f"CASE WHEN {x} IS NULL THEN {none} ELSE {_checks(c.of, x, path, depth)} END"
    if isinstance(c, Nullable):
        return f"CASE WHEN is_variant_null({x}) THEN {none} ELSE {_checks(c.of, x, path, depth)} END"
    at = lambda kind: f"try_variant_get({x}, '$', '{kind}')"
    kind, text = f"schema_of_variant({x})", at("string")
    match c:
        case Text():
            small = f"WHEN length({text}) < {c.least} THEN {say('empty' if c.least == 1 else f'shorter than {c.least}')}" if c.least else ""
            rest = f"WHEN {kind} <> 'STRING' THEN {say('not a string')} {small} ELSE {none}"
        case Moment():
            rest = f"WHEN {kind} <> 'STRING' THEN {say('not a string')} WHEN {text} RLIKE r'{ISO_Z}' AND try_cast({text} AS timestamp) IS NOT NULL THEN {none} ELSE {say('not an ISO time in UTC')}"
        case Choice():
            listed = ", ".join(f"'{v}'" for v in c.values)
            rest = f"WHEN {kind} <> 'STRING' THEN {say('not a string')} WHEN {text} IN ({listed}) THEN {none} ELSE {say('not one of ' + ', '.join(c.values))}"
        case Truth():
            rest = f"WHEN {kind} <> 'BOOLEAN' THEN {say('not a boolean')} ELSE {none}"
        case Whole():
            number = at("double")
            small = f"WHEN {number} < {c.least} THEN {say('negative' if c.least == 0 else f'less than {c.least}')}" if c.least is not None else ""
            rest = f"WHEN NOT {kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE)' THEN {say('not a number')} WHEN {number} <> floor({number}) THEN {say('not a whole number')} {small} ELSE {none}"
        case Listed():
            v, i = f"x{depth}", f"i{depth}"
            under = _under(path, f"cast({i} AS string)")
            if isinstance(c.of, Record):  # taken apart with the array; what isn't an object is null
                kind, each = f"array<{_members(c.of)}>", _member_checks(c.of, v, under, depth + 1)
            else:
                kind, each = "array<variant>", _checks(c.of, v, under, depth + 1)
            rest = f"ELSE coalesce(flatten(transform({at(kind)}, ({v}, {i}) -> {each})), {say('not an array')})"
        case Record():
            o = f"o{depth}"
            rest = f"ELSE element_at(transform(array({at(_members(c))}), {o} -> {_member_checks(c, o, path, depth + 1)}), 1)"
    return f"CASE WHEN {x} IS NULL THEN {say('missing')} {rest} END"


def _member_checks(c: Record, o: str, path: str, depth: int) -> str:
    """SQL of the issues of an object that was cast to _members(); null if it isn't one."""
    found = f"f{depth}"
    inner = "concat(" + ", ".join(_checks(of, f"{o}.`{c.key(n)}`", _under(path, f"'{c.key(n)}'"), depth) for n, of in c.fields.items()) + ")"
    for late, early, message in c.rules:
        values = [f"try_variant_get({o}.`{c.key(n)}`, '$', 'double')" for n in (late, early)]
        broken = f"CASE WHEN size({found}) = 0 AND {values[0]} < {values[1]} THEN {_say(_under(path, repr(c.key(late))), message)} ELSE {found} END"
        inner = f"element_at(transform(array({inner}), {found} -> {broken}), 1)"
    return f"CASE WHEN {o} IS NULL THEN {_say(path, 'not an object')} ELSE {inner} END"


def problems(c: Contract, v: Column) -> Column:
    """Issues of a variant, those of a record in the order of its fields; an empty array if there are none."""
    each = F.expr("doc -> cast(" + _checks(c, "doc", "''") + f" AS {ISSUES})")
    return F.element_at(F.call_function("transform", F.array(v), each), 1)


def _raw(c: Contract) -> str:
    """The type that a valid document is cast to at once: the document's own keys, times as text."""
    match c:
        case Moment():
            return "string"
        case Listed():
            return f"array<{_raw(c.of)}>"
        case Maybe() | Nullable():
            return _raw(c.of)
        case Record():
            return "struct<" + ",".join(f"`{c.key(n)}`:{_raw(x)}" for n, x in c.fields.items()) + ">"
    return ddl(c)


def _typed(c: Contract, x: Column) -> Column:
    match c:
        case Moment():
            return x.try_cast("timestamp")
        case Listed():
            return F.transform(x, lambda y: _typed(c.of, y))
        case Maybe() | Nullable():
            return _typed(c.of, x)
        case Record():
            return F.when(x.isNotNull(), F.struct(*(_typed(of, x[c.key(n)]).alias(n) for n, of in c.fields.items())))
    return x


def parsed(c: Contract, v: Column) -> Column:
    """The typed value of a variant that has no problems; what is absent is null."""
    return F.element_at(F.transform(F.array(F.try_variant_get(v, "$", _raw(c))), lambda x: _typed(c, x)), 1)


def _json(c: Contract, x: str, depth: int = 0) -> str:
    """SQL of the JSON text of a typed value; null for a null one, but for a Nullable."""
    match c:
        case Text() | Choice():
            return f"CASE WHEN {x} IS NOT NULL THEN substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2) END"
        case Moment():
            pattern = r"yyyy-MM-dd\'T\'HH:mm:ss.SSS\'Z\'"
            return f"""concat('"', date_format(to_utc_timestamp(cast({x} AS timestamp), current_timezone()), '{pattern}'), '"')"""
        case Whole() | Truth():
            return f"cast({x} AS string)"
        case Listed():
            e = f"e{depth}"
            return f"concat('[', array_join(transform({x}, {e} -> {_json(c.of, e, depth + 1)}), ','), ']')"
        case Nullable():
            return f"coalesce({_json(c.of, x, depth)}, 'null')"
        case Maybe():
            return _json(c.of, x, depth)
    parts = ", ".join(f"""concat('"{c.key(n)}":', {_json(of, f'{x}.{n}', depth)})""" for n, of in c.fields.items())
    return f"CASE WHEN {x} IS NOT NULL THEN concat('{{', concat_ws(',', {parts}), '}}') END"


def written(c: Contract, x: Column) -> Column:
    """JSON text of a typed value, keys in order; a null Maybe has no key, a null Nullable is null."""
    return F.element_at(F.call_function("transform", F.array(x), F.expr("rec -> " + _json(c, "rec"))), 1)
