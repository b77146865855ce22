"""Texts walked side by side end where each would end alone."""

import random

import numpy as np
import pytest

from tideline.llm import fingerprint


@pytest.mark.parametrize("together", [1, 3, 48])
def test_like_one_by_one(monkeypatch, together):
    monkeypatch.setattr(fingerprint, "TOGETHER", together)
    draw, walk = random.Random(8), fingerprint.shared_walk()
    texts = ["".join(draw.choice("abcdé \n") for _ in range(draw.choice([0, 0, 1, 5, 40, 40, 300]))) for _ in range(60)] + ["z" * 5_000]
    codes, at = [fingerprint.code_points(t) for t in texts], [draw.choice([0, 7, 1 << 16, 123_456]) for _ in texts]
    for got, c, start in zip(walk.ends_of(codes, at), codes, at, strict=True):
        assert got.tolist() == walk.ends(c, start)[0].tolist()
    assert walk.ends_of([], []) == []


def test_rows_of_pairs_like_the_definition():
    draw = random.Random(9)
    texts = ["", "x", "".join(draw.choice("abc de") for _ in range(90)), "ünï çode", "a" * 300, ""]
    docs = [fingerprint._Doc(k, t) for k, t in enumerate(texts)]
    rows = fingerprint._rows_of([(docs[k], docs[(k + 1) % len(docs)]) for k in range(len(docs))])
    for k, row in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [fingerprint.fingerprint_text(t) for t in (text, edited, after)]
        assert row[0] == k and row[1] == len(text) and row[3:5] == tuple(prints[:2])
        assert row[5:7] == (fingerprint.likeness(*prints[:2]), fingerprint.likeness(prints[0], prints[2]))


def test_band_keys_take_the_smallest_draws():
    said = fingerprint.fingerprint_text("some words of a text that is long enough for all samples " * 9)
    steps, symbols = fingerprint._read(said)
    for band, key in enumerate(fingerprint.band_keys(said)):
        salt = fingerprint._mix(np.array([band], np.uint64) + np.uint64(fingerprint.SEED << 30))
        order = np.argsort(fingerprint._mix(steps.astype(np.uint64) ^ salt))[: fingerprint.BAND_STEPS]
        total = fingerprint._mix(fingerprint._mix(steps.astype(np.uint64)) + symbols.astype(np.uint64))[order].sum(dtype=np.uint64)
        assert fingerprint._mix(np.array([total], np.uint64)).astype(np.int64)[0] == key
