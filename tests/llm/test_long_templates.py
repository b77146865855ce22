"""Templates longer than the stride of the registered ones."""

from __future__ import annotations

import random

from tideline.llm import licenses


def test_long_templates_are_found_wherever_they_stand(spark):
    rng = random.Random(81)
    words = [f"word{k}" for k in range(200)]
    full, notice, short = " ".join(words[:120]), " ".join(words[120:160]), "released under the mit license"
    templates = ((full, "full"), (notice, "notice"), (short, "mit"))
    rows, want = [], {}
    for k in range(40):
        text, label = (full, "full") if k % 2 else (notice, "notice")
        held = text.split()
        held[rng.randrange(len(held))] = "other"
        rows.append((k, " ".join([*(f"f{x}" for x in range(5 * k)), *held, "end"])))
        want[k] = label
    rows += [(100, " ".join(words[:90])), (101, "a released under the mit license b"), (102, "released " + "x " * 70 + "under the mit license"), (103, None)]
    want |= {100: "", 101: "mit", 102: "mit", 103: ""}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(docs, templates).collect()} == want
