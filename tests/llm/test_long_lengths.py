"""Packing of lengths beyond the exact histogram."""

from __future__ import annotations

from tideline.llm import packing


def test_boundaries_beyond_the_exact_histogram_are_real_lengths(spark):
    lengths = [5, 5, 9, 16_384, 16_385, 16_385, 16_500, 20_020, 20_001, 70_001]
    frame = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    for buckets in (32, 3, 1):
        rows = packing.pack(frame, buckets).collect()
        bounds = {r.bucket: r.padded for r in rows}
        assert len(rows) == len(lengths) and set(bounds.values()) <= set(lengths)
        assert all(r.n_tokens <= r.padded for r in rows)
        assert all(r.bucket == min(k for k, b in bounds.items() if b >= r.n_tokens) for r in rows)
    padded = {r.n_tokens: r.padded for r in packing.pack(frame).collect()}
    assert (padded[16_500], padded[70_001]) == (16_500, 70_001)
    alone = packing.pack(spark.createDataFrame([(1, 16_385)], "doc_id long, n_tokens long")).collect()
    assert [r.padded for r in alone] == [16_385]
