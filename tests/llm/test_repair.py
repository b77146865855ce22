"""Repair against a search over all edits of each conversation, and the automaton against its definition."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tideline.llm import repair

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return sorted(out, key=key)


def _brute(rows):
    """Cheapest first, ties by audit: the first finished repair of a search over all of them."""
    rows, seen, faults = _damaged(rows), set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, at, said = heapq.heappop(heap)
        if i == len(rows) and at in ("", "a"):
            break
        for full in ("user", "assistant"):
            if (at, full[0]) in GRAMMAR and audit[-2:] != "II":
                heapq.heappush(heap, (cost + 5, audit + "I", i, full[0], (*said, f"{full}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, at, said))
        if faults[i] in "kt":
            late = 5 * (faults[i] == "t")
            if (at, role[:1]) in GRAMMAR:
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*said, f"{role}:{text}")))
            for full in ("user", "assistant"):
                if (at, full[0]) in GRAMMAR:
                    heapq.heappush(heap, (cost + late + 1, audit + "R", i + 1, full[0], (*said, f"{full}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def _check(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, position int")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_damaged(table.repartition(3)).collect()}
    wanted = {}
    for conv in {r[0] for r in rows}:
        wanted[conv] = _brute([r for r in rows if r[0] == conv])
    assert got == wanted
    return got


def test_against_all_edits(spark):
    draw = random.Random(11)
    roles = ["system", "user", "user", "user", "assistant", "assistant", "tool", None, ""]
    texts = ["Fine.", "Well!", "cut off", "", " \n", None, "Also fine?", "Two. ", "é…"]
    rows = []
    for conv in [None, *range(220)]:
        turn = draw.randint(-3, 3)
        for _ in range(draw.randint(0, 7)):
            rows.append((conv, None if draw.random() < 0.05 else turn, draw.choice(roles), draw.choice(texts)))
            turn += draw.choice([1, 1, 1, 0, 2])
    got = _check(spark, rows)
    # A written turn costs more than any way without it, at these costs.
    assert set("".join(v[6] for v in got.values())) == set("KRD")


def test_all_rows_dropped(spark):
    conv = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _check(spark, [(conv, 0, "user", "Hello.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_damaged(empty).collect() == []
    _check(spark, [(5, t // 3, "user", "Same.") for t in range(12)] + [(6, None, "assistant", "Same.")] * 3)


def test_long_conversation_and_text(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"Turn {t}." if t % 7 else "no end") for t in range(4_000)]
    table = spark.createDataFrame([*rows, (2, 0, "user", "word " * 400_000), (2, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.repair_damaged(table).collect()}
    assert got[1].gaps > 0 and len(got[1].audit) >= sum(1 for r in _damaged(rows)) and got[2].conv_id == 2
    edits = repair.repair(repair.damage(table)).filter("conv_id = 1 AND position > 0").collect()
    assert [e.position for e in edits] == list(range(1, len(edits) + 1)) and "".join(e.edit for e in edits) == got[1].audit
    said = [e for e in edits if e.edit != "D"]
    assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in said).encode()).hexdigest() == got[1].repaired_sha256


def test_written_turns_where_they_are_cheap(spark, monkeypatch):
    monkeypatch.setattr(repair, "INSERTED", 1)
    monkeypatch.setattr(repair, "END", ((0, ""), (2, "I"), (1, "I"), (0, "")))
    nodes = [repair.END]
    for letter in "aus":
        nodes.append(repair.node(letter, nodes[-1]))
    assert repair.spelled("sua", nodes) == (0, "KKK")
    nodes = [repair.END, repair.node("u", repair.END)]
    assert repair.spelled("u", nodes) == (1, "KI")
    assert repair.spelled("a", [repair.END, repair.node("a", repair.END)]) == (1, "IK")


def test_nodes_are_distinct_suffixes(monkeypatch):
    """One solution for each distinct ending, however many words share it."""
    words = ["uaua", "suaua", "dua", "Ua", "xua", "uaua"]
    solved = []
    plain = repair.node
    monkeypatch.setattr(repair, "node", lambda letter, after: solved.append(letter) or plain(letter, after))
    last, nodes = "", [repair.END]
    for key in sorted({w[::-1] for w in words}):
        shared = len([1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(last, key, strict=False))])
        del nodes[shared + 1:]
        for letter in key[shared:]:
            nodes.append(repair.node(letter, nodes[-1]))
        last = key
    assert len(solved) == len({w[i:] for w in words for i in range(len(w))})


@pytest.mark.parametrize(("word", "cost", "audit"), [("", 0, ""), ("ua", 0, "KK"), ("a", 2, "D"), ("d", 2, "D"), ("u", 2, "D"), ("sua", 0, "KKK"), ("uu", 1, "KR"), ("S", 2, "D")])
def test_small_words(word, cost, audit):
    nodes = [repair.END]
    for letter in word[::-1]:
        nodes.append(repair.node(letter, nodes[-1]))
    assert repair.spelled(word, nodes) == (cost, audit)
