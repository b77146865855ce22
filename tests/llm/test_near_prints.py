"""Groups of near fingerprints against all pairs."""

from __future__ import annotations

import itertools
import random

import pytest

from tideline.llm import fingerprint
from tideline.llm.components import components
from tideline.llm.queries import QUERIES


def grouped(keys, pairs):
    label = {k: k for k in keys}
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    return label


def family(rng, n, changed):
    """Fingerprints of one length, each with a share of the first one's symbols changed."""
    said = [rng.randrange(256) for _ in range(fingerprint.SAMPLES)]
    return [bytes(rng.randrange(256) if rng.random() < changed else x for x in said) for _ in range(n)]


@pytest.mark.parametrize("block", [1024, 16])
def test_links_connect_all_near_pairs_of_a_band(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprint, "BLOCK", block)
    rng = random.Random(61)
    prints = {k: f"{fingerprint.SAMPLES}:{said.hex()}" for k, said in enumerate(family(rng, 90, 0.13))}
    # A near pair whose bands are led by others, near to neither.
    base = bytes.fromhex(prints[0].split(":")[1])
    one = bytes(x ^ 1 if k % 4 == 0 else x for k, x in enumerate(base))
    prints |= {200: f"{fingerprint.SAMPLES}:{one.hex()}", 201: f"{fingerprint.SAMPLES}:{(one[:-9] + bytes(9)).hex()}", 300: "0:"}
    bands = {k: set(enumerate(fingerprint.band_keys(f))) for k, f in prints.items()}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if bands[a] & bands[b] and fingerprint.likeness(prints[a], prints[b]) >= 0.8]
    links = fingerprint.near_links(spark.createDataFrame(list(prints.items()), "doc_id long, fingerprint string"))
    got = {r.id: r.label for r in components(links.selectExpr("doc_id AS a", "leader AS b")).collect()}
    want = grouped(prints, near)
    assert {k: got.get(k, k) for k in prints} == want and want[201] == want[200]
    assert all(fingerprint.likeness(prints[r.doc_id], prints[r.leader]) == r.likeness >= 0.8 for r in links.collect())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(63)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        b = "".join(rng.choice("abcß") if rng.random() < 0.2 else c * rng.choice((1, 1, 1, 0, 2)) for c in a)
        far, most = edits(a, b), rng.randint(0, 30)
        assert fingerprint._few_edits(a, b, most) == (far if far <= most else None)
        assert min(fingerprint._many_edits(a, b, most), most + 1) == min(far, most + 1)
        assert fingerprint.near_texts(a, b, 0.75) == (far <= max(len(a), len(b)) // 4)
    long = "".join(rng.choice("abcdefgh") for _ in range(4000))
    assert fingerprint.near_texts(long, "".join("z" if k % 9 == 0 else c for k, c in enumerate(long)), 0.8)
    assert not fingerprint.near_texts(long, "".join("z" if k % 3 == 0 else c for k, c in enumerate(long)), 0.8)


def test_the_query_groups_verified_texts(spark, tmp_path):
    rng = random.Random(65)
    # Two letters of one fingerprint, whose texts have nothing in common.
    seen = {}
    for code in range(0x4E00, 0x9000):
        twin = seen.setdefault(fingerprint.fingerprint_text(chr(code)), chr(code))
        if twin != chr(code):
            break
    text = "".join(rng.choice("abcdefghij klmno\n") for _ in range(3000))
    rows = [(9, text), (3, text[:1000] + "?" + text[1000:]), (4, text), (5, twin), (6, chr(code)), (7, None), (8, ""), (None, text)]
    rows += [(5, text[:-1]), (20, "".join(rng.choice("abcdefghij") for _ in range(900)))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_fingerprints"](spark, str(tmp_path))
    want = sorted([(9, 3), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 7), (-1, None), (5, 3), (20, 20)], key=str)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.group_id) for r in got.collect()), key=str) == want
    assert got.columns[:-1] == fingerprint.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).columns
