"""Conversation structure repair over a suffix-shared word automaton.

What a repair costs depends on a conversation's signature alone: one letter a row, for its role and its fault. The
signatures of all conversations are the words of an acyclic automaton that is built from the end. A node stands for
what may still follow, so conversations that end alike share their last nodes, however they begin; equal conversations
share all of them. For each node and each state of the role grammar, the least cost to the end and the best next edit
are found once. The best next edits spell the best audit suffix, so nothing longer than a letter is kept in a node.

The distinct signatures are sorted by their reversal, which puts words with a common ending side by side. A task walks
its range of them with one stack: whatever the next word shares with the last one is already solved. Only the nodes of
one word, at the border of two ranges, are solved twice. Neither the words nor the nodes ever meet in one place, and a
signature that a third of all conversations have is one word.

A conversation passes through a task row by row; only its signature (a byte a row) and its audit are held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tideline.llm.common import saved

BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits; letters sort as ties are broken.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLED, DELETED, INSERTED, LEFT_TRUNCATED = 1, 2, 5, 5
#: The grammar (s?(ua)+)?: states by the role initial that led there. It may stop at the start or after a reply.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLES = {"u": "user", "a": "assistant"}
#: The role a written turn takes in each state.
WRITTEN = {q: i for (q, i) in STEP if i in ROLES}
#: What a state costs and does at the end of a conversation.
END = ((0, ""), (2 * INSERTED, INSERT), (INSERTED, INSERT), (0, ""))
LEGAL = ("su", "ua", "au")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows with faults planted by crc32 of ``conv_id:turn``; nulls are one space.

    A dropped row stays with ``present`` false, so that its conversation is known; a repeated one comes twice.
    """
    named = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    code = F.pmod(F.crc32(named.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code"))
        .select(
            "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            (F.col("code") != 0).alias("present"), F.explode(times).alias("__time"),
        )
        .drop("__time")
    )


def _digest() -> Column:
    """Names a role and a text; also the last of the columns that order the rows of one turn."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def row_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, mark, initial``, without texts: ``mark`` is b, d, t or k for blank, duplicate, truncated, none.

    ``mark`` is null for rows that are not present. Of rows of one turn that are equal, all but the first are duplicates
    too; which one is first makes no difference, so they are told apart where rows pass in order.
    """
    bare = F.rtrim("text", F.lit(BLANK))
    plain = rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"),
        F.when(~F.col("present"), None).when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t").alias("mark"),
    )
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = plain.filter("mark <> 'b'").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    seen = plain.join(first.filter("n > 1"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("mark") != "b"), "left")
    return seen.withColumn("mark", F.when(F.col("first").isNotNull() & (place > F.col("first")), "d").otherwise(F.col("mark"))).drop("c", "d", "first", "n")


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation side by side, in order, in one task that they pass through."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _emit(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 4_096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of so many rows, or of 16 million characters of text."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == at_once or chars > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def signatures(faults: DataFrame) -> DataFrame:
    """A report per conversation, with its signature.

    Letters of a signature: ``d`` for rows that must go; for others the role initial (x for no initial of the grammar),
    upper case where the text is truncated.
    """
    schema = StructType([faults.schema["conv_id"], *StructType.fromDDL(f"{REPORT}, signature string").fields])
    arrow = _arrow(schema)

    def report(conv_id: object, rows: Iterator[tuple]) -> tuple:
        letters: list[str] = []
        counts = {"b": 0, "d": 0, "t": 0, "k": 0}
        low = high = at = before = None
        turns = illegal = 0
        for _, turn, _, digest, initial, mark in rows:
            if mark is None:
                continue
            if mark != "b" and before == (turn, digest):
                mark = "d"
            counts[mark] += 1
            if letters and at + initial not in LEGAL:
                illegal += 1
            if turn is not None and (low is None or turn != high):
                turns, low, high = turns + 1, turn if low is None else low, turn
            letter = initial if initial in ("s", "u", "a") else "x"
            letters.append("d" if mark in "bd" else letter.upper() if mark == "t" else letter)
            at, before = initial, (turn, digest)
        gaps = 0 if low is None else high - low + 1 - turns
        return conv_id, gaps, counts["b"], counts["d"], counts["t"], illegal, "".join(letters)

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit((report(k, g) for k, g in groupby(_rows(batches), key=lambda r: r[0])), arrow)

    columns = faults.select("conv_id", "turn", "role", "digest", "initial", "mark")
    return _in_order(columns, "turn", "role", "digest").mapInArrow(reports, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def node(letter: str, after: tuple) -> tuple:
    """Least cost to the end and best next edit of each grammar state, at a node that reads a letter and goes on to ``after``."""
    role, late = letter.lower(), LEFT_TRUNCATED if letter.isupper() else 0
    best = []
    for q in range(4):
        ways = [(after[q][0] + DELETED, DELETE)]
        if role != "d":
            if (q, role) in STEP:
                ways.append((after[STEP[q, role]][0] + late, KEEP))
            ways.append((after[STEP[q, WRITTEN[q]]][0] + late + REROLED, REROLE))
        best.append(min(ways))
    # An insertion stays at the node; two are enough to reach any state an insertion can reach.
    for _ in range(2):
        best = [min(best[q], (best[STEP[q, WRITTEN[q]]][0] + INSERTED, INSERT)) for q in range(4)]
    return tuple(best)


def spelled(signature: str, nodes: list[tuple]) -> tuple[int, str]:
    """Cost and audit of a signature whose nodes, from the end, are ``nodes``: the best next edits, one after another."""
    q, left, audit = START, len(signature), []
    while True:
        edit = nodes[left][q][1]
        if not edit:
            return nodes[-1][START][0], "".join(audit)
        audit.append(edit)
        if edit != INSERT:
            left -= 1
        if edit == KEEP:
            q = STEP[q, signature[len(signature) - left - 1].lower()]
        elif edit != DELETE:
            q = STEP[q, WRITTEN[q]]


def solved(words: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of each distinct signature. Ranges of reversed signatures are walked in order."""
    schema = StructType.fromDDL("signature string, cost long, audit string")
    arrow = _arrow(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            last, nodes = "", [END]
            for (key,) in _rows(batches):
                shared = next((i for i, (x, y) in enumerate(zip(last, key, strict=False)) if x != y), min(len(last), len(key)))
                del nodes[shared + 1:]
                for letter in key[shared:]:
                    nodes.append(node(letter, nodes[-1]))
                last = key
                yield key[::-1], *spelled(key[::-1], nodes)

        return _emit(found(), arrow)

    keys = words.select(F.reverse("signature").alias("key")).distinct()
    return keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(walk, schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, role, text`` and, at position 0, the report of each.

    Needs ``conv_id, turn, role, text`` (no nulls in the last two) and ``present``; a conversation none of whose rows is
    present has its report only. Position 0 holds ``gaps, blank, duplicate, truncated, illegal, cost, audit``; from 1 on
    there is a row per edit, in order: K as it was, R under the role given here, I written here, D with the row
    that goes. Rows of one turn go by role, then by a digest of role and text; null turns come first. Null ids are one
    conversation. The rows of a conversation lie side by side, in order, in one partition.
    """
    reports = saved(signatures(row_faults(rows)), "repair-reports")
    full = reports.join(solved(reports).withColumnRenamed("signature", "word"), F.col("signature") == F.col("word")).drop("signature", "word")
    given = [f.name for f in StructType.fromDDL(f"{REPORT}, cost long, audit string").fields]
    present = rows.filter("present").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text")
    both = full.withColumn("kind", F.lit(0)).unionByName(present, allowMissingColumns=True).select("conv_id", "kind", "turn", "role", "digest", "text", *given)
    schema = StructType([
        rows.schema["conv_id"], *StructType.fromDDL("position long, edit string, role string, text string").fields,
        *(full.schema[g] for g in given[:-1]), StructType().add("audit", StringType()).fields[0],
    ])
    arrow, nothing = _arrow(schema), (None,) * len(given)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
            head = next(group)
            yield conv_id, 0, None, None, None, *head[6:]
            q, position = START, 0
            for edit in head[-1]:
                position += 1
                role, text = (None, "") if edit == INSERT else (r := next(group))[3:4] + r[5:6]
                if edit in (INSERT, REROLE):
                    role = ROLES[WRITTEN[q]]
                if edit != DELETE:
                    q = STEP[q, role[0]]
                yield conv_id, position, edit, role, text, *nothing

    return _in_order(both, "kind", "turn", "role", "digest").mapInArrow(lambda batches: _emit(edits(batches), arrow), schema)


def digests(repaired: DataFrame) -> DataFrame:
    """A row per conversation: its report and ``repaired_sha256`` of the kept and written turns, ``role:text`` by lines.

    Reads the rows of ``repair`` as they lie in their partitions.
    """
    drop = ("position", "edit", "role", "text")
    schema = repaired.drop(*drop).schema.add("repaired_sha256", StringType())
    arrow = _arrow(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head, sha, turns = None, hashlib.sha256(), 0
        for row in _rows(batches):
            conv_id, position, edit, role, text = row[:5]
            if position == 0:
                if head is not None:
                    yield *head, sha.hexdigest()
                head, sha, turns = (conv_id, *row[5:]), hashlib.sha256(), 0
            elif edit != DELETE:
                sha.update((("\n" if turns else "") + f"{role}:{text}").encode())
                turns += 1
        if head is not None:
            yield *head, sha.hexdigest()

    return repaired.mapInArrow(lambda batches: _emit(hashed(batches), arrow), schema)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row per conversation, damaged and repaired: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Null roles and texts are one space, so such a row is blank or of no role; null turns come first and make no gaps;
    rows that repeat an id and turn are damaged alike and are turns of their own. Texts of any length are read whole.
    An empty table gives no rows. Other columns are not read.
    """
    return digests(repair(damage(conversations.select("conv_id", "turn", "role", "text"))))
