"""Escalation policies and runbook catalogs: JSON files described by tables of fields.

A reader turns one JSON value into what is stored, or notes why it cannot. Records are tables of readers, so the
shape of a file is data; one walk applies it and reports every problem of a file at once, each with its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from tideline.functions.frames import local_frame, utc
from tideline.functions.text import RFC3339
from tideline.schema import POLICY_LEVEL, RUNBOOK_STEP, STEP_KINDS, STEP_MODES

# fixed values: duration units in microseconds
DURATION_UNITS = {"ns": Fraction(1, 1000), "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
DURATION = re.compile(r"(?P<sign>[+-]?)(?P<parts>0|(?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|ms|s|m|h))+)")
DURATION_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


class ConfigError(ValueError):
    """A file that must not be used; ``problems`` lists all that is wrong with it."""

    def __init__(self, problems: list[str]) -> None:
        self.problems = problems
        super().__init__("; ".join(problems))


Note = Callable[[str], None]
Reader = Callable[[object, Note], object]


def text(value: object, note: Note) -> str:
    if value is None or isinstance(value, str):
        return value or ""
    note("is no text")
    return ""


def filled(value: object, note: Note) -> str:
    words = text(value, note)
    if not words.strip():
        note("is blank")
    return words


def one_of(*names: str) -> Reader:
    def read(value: object, note: Note) -> object:
        if value not in names:
            note(f"is {value!r}, not any of {list(names)}")
        return value

    return read


def duration_us(value: str) -> int | None:
    """Text such as ``1h30m`` as microseconds; None where it is no duration."""
    found = DURATION.fullmatch(value)
    if found is None:
        return None
    total = round(sum(Fraction(n if n[-1] != "." else n + "0") * DURATION_UNITS[u] for n, u in DURATION_PART.findall(found["parts"])))
    return -total if found["sign"] == "-" else total


def duration(least_us: int, optional: bool = False) -> Reader:
    def read(value: object, note: Note) -> int:
        words = text(value, note)
        if optional and not words:
            return 0
        us = duration_us(words)
        if us is None:
            note(f"is {words!r}, no duration such as 1h30m")
        elif us < least_us:
            note(f"is {words!r}, too short")
        return us or 0

    return read


def moment(value: object, note: Note) -> datetime | None:
    """An RFC 3339 time, or None where the field is absent."""
    words = text(value, note)
    if not words:
        return None
    try:
        if re.match(RFC3339, words):
            return utc(datetime.fromisoformat(words.replace(",", ".").replace("Z", "+00:00")))
    except ValueError:
        pass
    note(f"is {words!r}, no RFC 3339 time")
    return None


def text_map(value: object, note: Note) -> list[tuple[str, str]]:
    if value is None:
        return []
    if not isinstance(value, dict) or not all(isinstance(v, str) for v in value.values()):
        note("is no object of texts")
        return []
    return list(value.items())


def listed(one: Reader, least: int = 1) -> Reader:
    def read(value: object, note: Note) -> list:
        if value is not None and not isinstance(value, list):
            note("is no list")
            return []
        found = value or []
        if len(found) < least:
            note(f"has {len(found)} entries, not {least} or more")
        return [one(item, lambda words, i=i: note(f"[{i}]{_joined(words)}")) for i, item in enumerate(found)]

    return read


def _joined(words: str) -> str:
    """A note of a nested place goes on without a blank."""
    return words if words[:1] in ".[" else f" {words}"


def record(**fields: Reader) -> Reader:
    """An object with these keys, in any letter case, and no others."""

    def read(value: object, note: Note) -> dict:
        if not isinstance(value, dict | None):
            note("is no object")
            value = {}
        given = {key.lower(): item for key, item in (value or {}).items()}
        for key in sorted(given.keys() - fields.keys()):
            note(f"has an unknown key {key!r}")
        return {name: one(given.get(name), lambda words, name=name: note(f".{name}{_joined(words)}")) for name, one in fields.items()}

    return read


def _webhook_has_target(step: Reader) -> Reader:
    def read(value: object, note: Note) -> dict:
        found = step(value, note)
        if found["kind"] == "webhook" and not found["target"].strip():
            note(".target is blank, and a webhook needs one")
        return found

    return read


def _own_ids(books: Reader) -> Reader:
    def read(value: object, note: Note) -> list:
        found = books(value, note)
        ids = [book["id"] for book in found]
        for i, id_ in enumerate(ids):
            if id_.strip() and id_ in ids[:i]:
                note(f"[{i}].id repeats {id_!r}")
        return found

    return read


POLICY = record(
    levels=listed(record(
        target=filled,
        ack_timeout=duration(least_us=1),
        rotation=record(contacts=listed(record(name=filled, address=text)), start=moment, shift=duration(least_us=0, optional=True)),
    )),
)
CATALOG = record(
    runbooks=_own_ids(listed(record(
        id=filled,
        name=text,
        match=record(rule_id=filled, service_name=text, severity=text),
        approval_timeout=duration(least_us=1),
        steps=listed(_webhook_has_target(record(name=filled, kind=one_of(*STEP_KINDS), mode=one_of(*STEP_MODES), target=text, params=text_map))),
    ))),
)


def read_document(document: str, shape: Reader, what: str) -> dict:
    """A whole file by its shape; ``ConfigError`` with every problem there is."""
    try:
        value = json.loads(document)
    except ValueError as err:
        raise ConfigError([f"{what} is no JSON: {err}"]) from err
    problems: list[str] = []
    found = shape(value, lambda words: problems.append(f"{what}{_joined(words)}"))
    if problems:
        raise ConfigError(problems)
    return found


def policy_rows(document: str) -> list[dict]:
    """One row per level, numbered from 1."""
    return [
        {
            "level": number, "target": level["target"], "ack_timeout_us": level["ack_timeout"],
            "contacts": level["rotation"]["contacts"], "start": level["rotation"]["start"], "shift_us": level["rotation"]["shift"],
        }
        for number, level in enumerate(read_document(document, POLICY, "policy")["levels"], start=1)
    ]


def runbook_rows(document: str) -> list[dict]:
    """One row per step, runbooks and steps numbered from 1."""
    return [
        {
            "ordinal": ordinal, "runbook_id": book["id"], "name": book["name"], "match_rule_id": book["match"]["rule_id"],
            "match_service": book["match"]["service_name"], "match_severity": book["match"]["severity"],
            "approval_timeout_us": book["approval_timeout"], "step_index": index, "step_name": step["name"],
            **{key: step[key] for key in ("kind", "mode", "target", "params")},
        }
        for ordinal, book in enumerate(read_document(document, CATALOG, "catalog")["runbooks"], start=1)
        for index, step in enumerate(book["steps"], start=1)
    ]


def parse_policy(spark: SparkSession, document: str) -> DataFrame:
    return local_frame(spark, policy_rows(document), POLICY_LEVEL)


def parse_runbooks(spark: SparkSession, document: str) -> DataFrame:
    return local_frame(spark, runbook_rows(document), RUNBOOK_STEP)


def _whole_text(spark: SparkSession, path: str) -> str:
    """A configuration file is one document; it is read like any other path Spark can reach."""
    return spark.read.text(path, wholetext=True).first()[0]


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """One row per escalation level, in order."""
    return parse_policy(spark, _whole_text(spark, path))


def load_runbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row per runbook step, in catalog and step order."""
    return parse_runbooks(spark, _whole_text(spark, path))
