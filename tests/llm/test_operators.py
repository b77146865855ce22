"""Each training-data operator against brute force on small tables, with the odd cases its docstring defines."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import chat, classlm, exact, fingerprint, licenses, lines, minhash, mixing, packing, quality
from tideline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket string, words string, rank string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and long texts, copies, ties in nothing but the text, and code points beyond the first plane."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "a"), (2, base, "b"), (3, " ".join(near), "a"), (4, None, "a"), (5, "", None), (6, "x", "b"),
        (7, prose(rng, 20_000), "a"), (8, "𝔘𝔫𝔦 ß\n\né à\n" * 5, "c"), (9, "one\ntwo\nthree\nfour", "c"), (10, "zero\none\ntwo\nthree", None),
        (11, prose(rng, 300), "b"), (12, "\n\n\n\n\n", "a"), (13, "x", "a"), (14, "a\\b<turn>", "a"),
    ]
    return rows + [(20 + k, prose(rng, rng.randint(1, 60)), rng.choice("abc")) for k in range(30)]


# fingerprints ---------------------------------------------------------------------------------------------------------


def walked(text):
    """The walk one step at a time."""
    walk, out, at, step = fingerprint.shared_walk(), [], 0, 0
    codes = fingerprint.code_points(text)
    kinds = (fingerprint._mix(codes.astype(np.uint64) + np.uint64(fingerprint.SEED)) & np.uint64(fingerprint.WALKS - 1)).astype(int)
    while at < len(codes):
        out.append(int(codes[at]))
        # The walk moves on where it stays one step more.
        at += walk.stay[kinds[at]][step % fingerprint.PERIOD] == 1
        step += 1
    return out


def test_fingerprint_is_a_sample_of_the_walk():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 700):
        text = prose(rng, n)
        steps = np.array(walked(text), dtype=np.uint64)
        priority = fingerprint._mix(np.arange(len(steps), dtype=np.uint64) + np.uint64(fingerprint.SEED << 40))
        sampled = np.sort(np.argsort(priority, kind="stable")[: fingerprint.SAMPLES])
        said = (fingerprint._mix(steps[sampled] + np.uint64(fingerprint.SEED << 20)) >> np.uint64(56)).astype(np.uint8).tobytes().hex()
        assert fingerprint.fingerprint_text(text) == f"{len(steps)}:{said}"


def test_likeness_follows_edits():
    rng = random.Random(2)
    text = prose(rng, 600)
    few = text[:1000] + "!" + text[1000:2000] + text[2003:]
    assert fingerprint.likeness(fingerprint.fingerprint_text(text), fingerprint.fingerprint_text(text)) == 1.0
    near = fingerprint.likeness(fingerprint.fingerprint_text(text), fingerprint.fingerprint_text(few))
    far = fingerprint.likeness(fingerprint.fingerprint_text(text), fingerprint.fingerprint_text(prose(rng, 600)))
    assert near > 0.7 > 0.3 > far
    assert fingerprint.likeness("0:", "0:") == 1.0 and fingerprint.likeness("0:", fingerprint.fingerprint_text("abc")) == 0.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_fingerprints(spark, odd_rows, partitions):
    rows = [*odd_rows, (None, "no id", "a")]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(table(spark, rows).repartition(partitions)).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    assert len(got) == len(rows)
    for (key, text, _), (_, after, _) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.fingerprint_text(text), fingerprint.fingerprint_text(edited))
        assert r.near_edited == fingerprint.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint_text(after))


def test_edited_fingerprints_of_one_and_none(spark):
    one = fingerprint.edited_fingerprints(table(spark, [(5, "abcd", "a")])).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(5, hashlib.sha256(b"abab").hexdigest())]
    assert fingerprint.edited_fingerprints(table(spark, [])).count() == 0


def test_near_links_of_fingerprints(spark):
    rng = random.Random(5)
    text = prose(rng, 500)
    rows = [(i, text[: 500 * i + 100] + "?" + text[500 * i + 100 :], "a") for i in range(6)] + [(10 + i, prose(rng, 500), "a") for i in range(6)]
    prints = {}
    for key, t, _ in rows:
        prints.setdefault(fingerprint.fingerprint_text(t), key)
    bands = defaultdict(list)
    for f, key in prints.items():
        for band in enumerate(fingerprint.band_keys(f)):
            bands[band].append((key, f))
    met = {(k, min(ks)) for ks in bands.values() for k in ks if k != min(ks)}
    want = {(a[0], b[0]) for a, b in met if fingerprint.likeness(a[1], b[1]) >= 0.5}
    found = fingerprint.near_links(fingerprint.fingerprints(table(spark, rows)), 0.5).collect()
    assert {(r.doc_id, r.leader) for r in found} == want and want
    groups = {r.doc_id: r.group_id for r in fingerprint.near_groups(table(spark, [*rows, (30, rows[0][1], "a"), (31, None, "a")]), 0.5).collect()}
    assert groups == {**{k: 0 for k in range(6)}, **{10 + k: 10 + k for k in range(6)}, 30: 0, 31: 31}


# exact ----------------------------------------------------------------------------------------------------------------


def test_exact_duplicates(spark, odd_rows):
    rows = [*odd_rows, (None, "x", "a"), (None, "alone", "a"), (13, "x", "a")]
    groups = defaultdict(list)
    for key, text, _ in rows:
        groups[text or ""].append(key)
    want = Counter()
    for text, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        for k in keys:
            want[(k, best, len(keys), k == best, hashlib.sha256(text.encode()).hexdigest())] += 1
    for table_bytes in (exact.TABLE_BYTES, 2_000):  # the small tables force the recursion
        got = exact.exact_duplicates(table(spark, rows).repartition(3), table_bytes).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact.exact_duplicates(table(spark, [])).count() == 0


def test_colliding_hashes_stay_apart():
    held = exact.TextTable()
    for i in range(3000):
        held.add(i % 1500 % 7, str(i % 1500).encode(), 1, i)
    assert len(held.entries) == 1500 and all(e[2] == 2 and e[3] == int(e[1]) + 1500 for e in held.entries)


# lines ----------------------------------------------------------------------------------------------------------------


def lines_by_hand(rows):
    seen, out = set(), {}
    for key, text, _ in sorted(rows):
        parts = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(parts) - 2):
            window = tuple(parts[i : i + 3])
            if "".join(window).strip(" "):
                if window in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(window)
        kept = [p for i, p in enumerate(parts) if i not in gone]
        out[key] = (len(parts), len(gone), None if text is None else "\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = [f"line {i}" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 40))), "a") for i in range(40)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "same\n" * 9, "a"), (103, "a\nb", "a"), (104, "a\nb", "a"), (105, "\n" * 8, "a")]
    got = lines.drop_repeated_lines(table(spark, rows).repartition(4))
    assert set(got.columns) == {*table(spark, []).columns, "n_lines", "n_removed"}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == lines_by_hand(rows)
    assert lines.drop_repeated_lines(table(spark, [])).count() == 0
    # Repeated rows are one occurrence; a null id comes first.
    twice = [(1, "p\nq\nr", "a"), (1, "p\nq\nr", "a"), (None, "p\nq\nr", "a")]
    assert sorted((r.doc_id or 0, r.text) for r in lines.drop_repeated_lines(table(spark, twice)).collect()) == [(0, "p\nq\nr"), (1, ""), (1, "")]


# minhash --------------------------------------------------------------------------------------------------------------


def shingled(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else Counter()


def weighted_similarity(a, b):
    if not a or not b:
        return float(a == b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def test_similarity_formula():
    rng = random.Random(9)
    for _ in range(100):
        one, other = (" ".join(rng.choice("ab") for _ in range(rng.randint(0, 25))) for _ in "12")
        got = minhash.probability_jaccard(*minhash.shingles(one), *minhash.shingles(other))
        assert got == pytest.approx(weighted_similarity(shingled(one), shingled(other)))


def test_registers_estimate_similarity():
    rng = random.Random(11)
    one = prose(rng, 400)
    words = one.split()
    for k in range(0, 400, 40):
        words[k] = "other"
    (a, wa), (b, wb) = minhash.shingles(one), minhash.shingles(" ".join(words))
    estimate = (minhash.registers(a, wa.astype(float), 2048) == minhash.registers(b, wb.astype(float), 2048)).mean()
    assert estimate == pytest.approx(minhash.probability_jaccard(a, wa, b, wb), abs=0.04)


def test_pieces_do_not_change_words(monkeypatch):
    raw = prose(random.Random(4), 3000).encode()
    whole = minhash.word_hashes(raw)
    monkeypatch.setattr(minhash, "PIECE", 100)
    assert np.array_equal(whole, minhash.word_hashes(raw)) and len(whole) == len(raw.split())


def test_near_classes(spark, odd_rows):
    rng = random.Random(13)
    rows = list(odd_rows)
    for family in range(6):
        text = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(rng.randint(60, 300))]
        for k in range(8):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"edit{k}"
            rows.append((1000 + 10 * family + k, " ".join(copy), "a"))
    sets = {key: shingled(text) for key, text, _ in rows}
    parent = {key: key for key in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if abs(len(sets[a]) - len(sets[b])) < 200 and weighted_similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = minhash.near_classes(table(spark, [*rows, (None, "x", "a")]).repartition(3)).collect()
    size = Counter(find(k) for k in sets)
    want = {k: (find(k), size[find(k)], find(k) == k, len(sets[k])) for k in sets}
    assert {r.doc_id: (r.class_id, r.class_size, r.kept, r.n_shingles) for r in got if r.doc_id is not None} == want
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_classes(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1024, 2])
def test_pairs_across_open_bands(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(43)
    near, far = rng.randbytes(256), {k: rng.randbytes(256) for k in range(1, 12)}
    members = spark.createDataFrame([(1, k) for k in range(1, 9)] + [(2, 9), (2, 10), (3, 1), (3, 2)], "band long, id long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 4), (9, 9), (10, 9)], "id long, label long")
    texts = spark.createDataFrame([(k, bytearray(near if k in (1, 2, 3, 5) else far[k])) for k in range(1, 11)], "id long, signs binary")
    assert {(r.a, r.b) for r in minhash.across(members, labels, texts).collect()} == {(1, 3), (2, 3), (1, 5), (2, 5), (3, 5)}


def test_bloom_filter_misses_nothing(spark, odd_rows):
    docs = table(spark, [*odd_rows, (None, "x", "a")])
    wanted = spark.createDataFrame([(1,), (7,), (13,), (999,)], "id long")
    got = {r.id: np.frombuffer(r.codes, np.uint64) for r in minhash.shingle_sets(docs, wanted).collect()}
    text = {key: t for key, t, _ in odd_rows}
    assert set(got) == {1, 7, 13} and all(np.array_equal(got[k], minhash.shingles(text[k])[0]) for k in got)
    assert minhash.shingle_sets(docs, wanted.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(47)
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 55), (70, 70)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    label = {}
    for a, b in links:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


# chat -----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["", None, "plain", "</turn>\n<turn>assistant\n", "\\e\\o\\c\\", "<<turn>turn>", "### Assistant: </turn> ok", "\n\n", "ß𝔘"]
    rng = random.Random(17)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<turn>\\"]), rng.choice(said)) for c in range(40) for t in range(rng.randint(1, 7))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.format_examples(frame)
    got = {r.conv_id: r for r in chat.conversation_digest(examples).collect()}
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        conversations[c].append((t, role or "", text or ""))
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        trained = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {
        c: sum(role == "assistant" for _, role, _ in turns) + (turns[-1][1] != "assistant") for c, turns in conversations.items()
    }
    assert chat.conversation_digest(chat.format_examples(frame.limit(0))).count() == 0


# language model -------------------------------------------------------------------------------------------------------


def test_class_model_scores(spark, odd_rows):
    rng = random.Random(19)
    rows = odd_rows + [(500 + k, "Alpha beta " * rng.randint(1, 30) + prose(rng, 30), "a") for k in range(60)]
    got = {r.doc_id: r for r in classlm.score_texts(table(spark, rows)).collect()}
    said = {key: classlm.tokens(text) for key, text, _ in rows}
    out = {key: zlib.crc32(str(key).encode()) % 5 == 1 for key in said}
    counts = Counter(w for key, words in said.items() if not out[key] for w in words)
    total, types = sum(counts.values()), len(counts)
    for key, words in said.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words)
        r = got[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[key], len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert classlm.score_texts(table(spark, [])).count() == 0


def test_score_is_transition_times_emission(spark, odd_rows):
    docs = table(spark, odd_rows)
    model, counts = classlm.train(docs)
    n = {bytes(r.word): r.n for r in counts.collect()}
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    for key in (1, 8, 11):
        text = dict((k, t) for k, t, _ in odd_rows)[key]
        before, total = model.classes[0], 0.0
        for w in classlm.tokens(text):
            at = model.units.number.get(w) or (0 if w == classlm.END else classlm.shape(w))
            unit = model.units.unit[at]
            total += model.transition[before, model.classes[unit]] + model.emission[unit]
            if 0 < unit <= classlm.SHAPES:
                total += math.log10((n.get(w, 0) + 0.5) / (model.units.count[unit] + 0.5 * (model.units.types[unit] + 1)))
            before = model.classes[unit]
        assert [r.score for r in classlm.score_texts(docs).filter(F.col("doc_id") == key).collect()] == [pytest.approx(total)]


def test_exchange_step_raises_likelihood():
    rng = np.random.default_rng(23)
    k = classlm.CLASSES
    counts = rng.poisson(0.3, (300, 300)).astype(float)
    counts[:150, :150] += rng.poisson(4, (150, 150))
    classes = rng.integers(0, k, 300)

    def table_of(c):
        member = np.eye(k)[c]
        return member.T @ counts @ member

    def likelihood(c):
        t = table_of(c)
        return classlm._xlogx(t).sum() - classlm._xlogx(t.sum(axis=0)).sum() - classlm._xlogx(t.sum(axis=1)).sum()

    start = likelihood(classes)
    for w in range(0, 300, 10):  # one at a time, exchange never loses
        member = np.eye(k)[classes]
        best = classlm.best_moves((counts @ member)[[w]], (counts.T @ member)[[w]], classes[[w]], table_of(classes))
        before, classes[w] = likelihood(classes), best[0]
        assert likelihood(classes) >= before - 60  # the pair of a word with itself is not in the criterion
    assert likelihood(classes) > start


# mixing ---------------------------------------------------------------------------------------------------------------


def test_shares_and_flow():
    assert mixing.share_by_weight({"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 1, "c": 2})["a"] == 30
    shares = mixing.share_by_weight({"a": 0, "b": 5}, {"a": 3, "b": 1})
    assert shares == {"a": 0, "b": 5.0}
    flows = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 0}, {"a": 15, "b": 12})
    assert sum(f for parts in flows.values() for s, f in parts if s == "b") == 12
    assert sum(f for parts in flows.values() for s, f in parts if s == "a") == 15
    # Repeating costs more each lap: 27 words of 20 leave as few laps as can be.
    assert sum(f for _, f in flows[("a",)]) + sum(f for _, f in flows[("a", "b")]) == 27
    assert max(sum(f for _, f in parts) for parts in flows.values()) <= 20


def test_flow_is_cheapest():
    rng = random.Random(29)
    for _ in range(60):
        names = "abc"
        keys = [k for n in (1, 2, 3) for k in itertools.combinations(names, n) if rng.random() < 0.6] or [("a",)]
        patterns = {k: rng.randint(0, 3) for k in keys}
        quotas = {s: rng.randint(0, 4) for s in names}
        flows = mixing.route(patterns, quotas)

        def cost(used):
            return sum(lap * lap * min(max(used[k] - lap * patterns[k], 0), patterns[k]) for k in keys for lap in range(3))

        best = None
        for split in itertools.product(*(range(3 * patterns[k] + 1) for k in keys)):
            if sum(split) > sum(quotas.values()):
                continue
            used = dict(zip(keys, split, strict=True))
            feasible = all(
                sum(used[k] for k in keys if set(k) <= set(group)) <= sum(quotas[s] for s in group)
                for n in (1, 2, 3) for group in itertools.combinations(names, n)
            )
            if feasible:
                rank = (-sum(split), cost(used))
                best = rank if best is None else min(best, rank)
        got = {k: sum(f for _, f in flows[k]) for k in keys}
        assert (-sum(got.values()), cost(got)) == best
        for s in names:
            assert sum(f for parts in flows.values() for t, f in parts if t == s) <= quotas[s]


def test_mix_documents(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    docs = table(spark, odd_rows)
    got = mixing.mix_documents(docs.repartition(3)).collect()
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(odd_rows)
    source = {key: s for key, _, s in odd_rows}
    size = {key: len((text or "").split()) for key, text, _ in odd_rows}
    totals = Counter()
    for k, n in size.items():
        totals[source[k]] += n
    targets = mixing.share_by_weight(dict(totals), mixing.weights_of(list(totals)))
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], totals[source[r.doc_id]]) and r.target == pytest.approx(targets[source[r.doc_id]])
        assert r.taken in {r.size * k for k in range(4)}
        taken[source[r.doc_id]] += r.taken
    for s in totals:
        assert abs(taken[s] - targets[s]) <= max((size[k] for k in size if source[k] == s), default=0)
    assert mixing.mix_documents(table(spark, [])).count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(100)] + [(200, [], 5), (201, ["b", None], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    got = mixing.mix(docs, {"a": 700, "b": 300}).collect()
    by_source = Counter()
    for r in got:
        for part in r.laps_by_source:
            by_source[part.source] += part.laps * r["size"]
    assert abs(by_source["a"] - 700) <= 10 and abs(by_source["b"] - 300) <= 10


# licences -------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    rng = random.Random(31)
    notice = [t for t, _ in licenses.TEMPLATES]
    rows = [(1, None, "a"), (2, "", "a"), (3, "CC-BY 4.0; All  rights\nreserved", "a"), (4, "cc by cc by", "a"), (5, "General PublicK License", "a")]
    for k in range(40):
        words = prose(rng, rng.randint(0, 150)).split()
        text = rng.choice(notice).split()
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "zzz"
        at = rng.randint(0, len(words))
        rows.append((10 + k, " ".join(words[:at] + [w.upper() for w in text] + words[at:]), "a"))
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    import re

    for key, text, _ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        found, best = set(), 0.0
        for start in range(0, max(1, len(words)), licenses.STRIDE):
            block = set(words[start : start + 2 * licenses.STRIDE])
            for template, label in licenses.TEMPLATES:
                members = set(template.split())
                if len(block & members) >= licenses.needed(len(members), licenses.THRESHOLD):
                    found.add(label)
                    best = max(best, len(block & members) / len(members))
        base = sorted({label for _, label in places})
        want = (
            len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(base), ",".join(sorted({*base, *found})), 1.0 if places else best,
        )
        r = got[key]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want
    assert licenses.scan_licenses(table(spark, [])).count() == 0


# quality --------------------------------------------------------------------------------------------------------------


def test_isotonic_is_the_least_squares_fit():
    x, y = quality.isotonic([(0.1, 0.0, 50), (0.2, 1.0, 10), (0.3, 0.0, 30), (0.4, 1.0, 40)])
    assert list(y) == sorted(y) and len(x) == 3 and 0 < y[0] < y[-1] < 1


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n", "x", "ß" * 1000, "\ud800 lone"):
        values = quality.statistics(text)
        assert values.shape == (len(quality.STATISTICS),) and np.isfinite(values).all()


def test_classifier_separates(spark):
    rng = random.Random(37)
    rows = [(i, prose(rng, rng.randint(20, 80)) if i % 3 else "$$$ " * rng.randint(20, 80) + "!!", "a") for i in range(400)]
    labels = [(i, int(bool(i % 3)), 0) for i in range(0, 400, 2)] + [(1, None, 0), (None, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, [*rows, (900, None, "a"), (901, "", "a")]), frame).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == int(bool(r.doc_id % 3)) for r in held]) > 0.95
    empty = {r.doc_id: r.score for r in got if r.doc_id >= 900}
    assert empty[900] == empty[901]
    unlabelled = quality.classify(table(spark, rows[:5]), frame.limit(0)).collect()
    assert [r.score for r in unlabelled] == [0.5] * 5


# packing --------------------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(41)
    for _ in range(300):
        bins = [(n, rng.randint(1, 9)) for n in rng.sample(range(40), rng.randint(1, 8))]
        k = rng.randint(1, 4)
        bounds = packing.optimal_boundaries(bins, k)
        cost = sum(c * min(b for b in bounds if b >= n) for n, c in bins)
        lengths = sorted(n for n, _ in bins)
        best = min(
            sum(c * min(b for b in (*cut, lengths[-1]) if b >= n) for n, c in bins)
            for size in range(min(k, len(bins)))
            for cut in itertools.combinations(lengths[:-1], size)
        )
        assert len(bounds) <= k and cost == best
    assert packing.optimal_boundaries([]) == []


def test_packing(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 5)
    got = packing.pack_documents(table(spark, odd_rows), buckets=4, batch_tokens=100).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {key: len((text or "").split()) for key, text, _ in odd_rows}
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.padded
        batches[(r.bucket, r.batch)].append(r)
    for rows in batches.values():
        assert len({r.padded for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].padded <= 100
    full = Counter(b for b, _ in batches)
    for bucket, n in full.items():
        fits = max(1, 100 // max(1, batches[(bucket, 0)][0].padded))
        assert sorted(len(batches[(bucket, i)]) for i in range(n))[1:] == [fits] * (n - 1)
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_histogram_length(spark):
    lengths = [0, 1, 16_384, 16_385, 100_000, 10_000_000]
    frame = spark.createDataFrame([(n,) for n in lengths], "n long")
    bins = [r.b for r in frame.select(packing.histogram_length(F.col("n")).alias("b")).collect()]
    assert bins[:3] == lengths[:3] and all(n <= b <= n * 1.01 for n, b in zip(lengths[3:], bins[3:], strict=True))
