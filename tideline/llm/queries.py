"""The catalogue of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chat, classlm, exact, fingerprint, licenses, lines, minhash, mixing, packing, quality, repair, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


#: A text made of the template's own signs; both turns of conversation -7 say it.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.conversation_digest(chat.format_examples(rows))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score_texts(_table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_class_lm": op6_class_lm,
    "op7_mix": op7_mix,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_repair": op13_repair,
}


def _license_sql() -> str:
    """Every block against every template, with nothing filtered first."""
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({sorted(set(t.split()))!r}, '{label}')" for t, label in licenses.TEMPLATES)
    return rf"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents),
        phrases(parts, label) AS (VALUES {phrases}),
        templates(members, label) AS (VALUES {templates}),
        starts AS (SELECT doc_id, words, unnest(range(len(words))) AS w FROM split),
        places AS (
            SELECT doc_id, w, label FROM starts JOIN phrases
            ON words[w + 1] = parts[1] AND words[w + 1 : w + len(parts)] = parts),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(w) AS first_word, max(w) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM places GROUP BY doc_id),
        blocks AS (
            SELECT doc_id, list_distinct(words[b * {licenses.STRIDE} + 1 : (b + 2) * {licenses.STRIDE}]) AS held
            FROM (SELECT doc_id, words, unnest(range(greatest(1, (len(words) + {licenses.STRIDE} - 1) // {licenses.STRIDE}))) AS b FROM split)),
        met AS (
            SELECT doc_id, label, len(list_intersect(held, members)) / len(members) AS containment
            FROM blocks CROSS JOIN templates
            WHERE len(list_intersect(held, members)) >= greatest(1, ceil({licenses.THRESHOLD} * len(members) - 1e-9))),
        labelled AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
            FROM (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM places) GROUP BY doc_id),
        best AS (SELECT doc_id, max(containment) AS best FROM met GROUP BY doc_id)
        SELECT s.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END :: DOUBLE AS score
        FROM split s LEFT JOIN base USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN best USING (doc_id)"""


def _repair_sql() -> str:
    """Every conversation on its own: a table of the four grammar states, filled from the end.

    A cell is the cost in twelve digits before the audit, so that the least text is the cheapest edit, ties ASCII-least.
    """
    written = {repair.START: repair.AFTER_U, repair.AFTER_S: repair.AFTER_U, repair.AFTER_U: repair.AFTER_A, repair.AFTER_A: repair.AFTER_U}
    kept = {repair.START: (("s", 1), ("u", 2)), repair.AFTER_S: (("u", 2),), repair.AFTER_U: (("a", 3),), repair.AFTER_A: (("u", 2),)}

    def plus(cell: str, cost: str, edit: str) -> str:
        return f"lpad((CAST(left({cell}, 12) AS BIGINT) + {cost})::VARCHAR, 12, '0') || '{edit}' || substr({cell}, 13)"

    def own(q: int) -> str:
        keep = " ".join(f"WHEN lower(letter) = '{i}' THEN {plus(f'b{to}', 'late', 'K')}" for i, to in kept[q])
        reroled = plus(f"b{written[q]}", "late + 1", "R")
        return f"least({plus(f'b{q}', '2', 'D')}, CASE {keep} END, CASE WHEN letter <> 'd' THEN {reroled} END) AS b{q}"

    def inserted(q: int) -> str:
        return f"least(b{q}, {plus(f'b{written[q]}', '5', 'I')}) AS b{q}"

    states = range(4)
    return rf"""
        WITH RECURSIVE bytes AS (
            SELECT [list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]),
                                lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))
                    FOR i IN range(256)] AS step),
        coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(
                           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                           lambda x: ord(x)::BIGINT)),
                       lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % 20 AS code
            FROM conversations, bytes),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                   CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM coded)),
        placed AS (
            SELECT *, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos,
                left(role, 1) AS initial
            FROM damaged),
        judged AS (
            SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS is_blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS is_seen,
                   NOT regexp_matches(text, '[.!?][ 	-
]*$') AS is_cut,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
            FROM placed),
        lettered AS (
            SELECT *, CASE WHEN is_blank OR is_seen THEN 'd'
                           WHEN is_cut THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END)
                           WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS letter
            FROM judged),
        reports AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND is_seen) AS duplicate,
                   count(*) FILTER (NOT is_blank AND NOT is_seen AND is_cut) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                   string_agg(letter, '' ORDER BY pos) AS word
            FROM lettered GROUP BY conv_id),
        best AS (
            SELECT conv_id, word, 0 AS done, '000000000000' AS b0, '000000000010II' AS b1, '000000000005I' AS b2, '000000000000' AS b3
            FROM reports
            UNION ALL
            SELECT conv_id, word, done, {", ".join(inserted(q) for q in states)} FROM (
                SELECT conv_id, word, done, {", ".join(inserted(q) for q in states)} FROM (
                    SELECT conv_id, word, done + 1 AS done, {", ".join(own(q) for q in states)}
                    FROM (SELECT *, word[len(word) - done] AS letter,
                                 CASE WHEN word[len(word) - done] IN ('S', 'U', 'A', 'X') THEN 5 ELSE 0 END AS late
                          FROM best WHERE done < len(word))))),
        audits AS (SELECT conv_id, CAST(left(b0, 12) AS BIGINT) AS cost, substr(b0, 13) AS audit FROM best WHERE done = len(word)),
        edits AS (
            SELECT conv_id, edit, nth,
                   count(*) FILTER (edit <> 'I') OVER upto AS pos, count(*) FILTER (edit <> 'D') OVER upto AS spoken
            FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS nth
                  FROM audits WHERE audit <> '')
            WINDOW upto AS (PARTITION BY conv_id ORDER BY nth)),
        written AS (
            SELECT e.*, p.role, CASE WHEN edit = 'I' THEN '' ELSE p.text END AS text,
                   max(CASE WHEN spoken = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
            FROM edits e LEFT JOIN placed p ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.pos = p.pos
            WHERE edit <> 'D'),
        repaired AS (
            SELECT conv_id, string_agg(
                CASE WHEN edit = 'K' THEN role WHEN (spoken - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                chr(10) ORDER BY nth) AS whole
            FROM written GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN reports r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
        LEFT JOIN audits a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN repaired w ON c.conv_id IS NOT DISTINCT FROM w.conv_id"""


ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op3_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
            FROM documents),
        windows AS (
            SELECT * FROM (
                SELECT doc_id, pos, line AS l1, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3
                FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
            WHERE l3 IS NOT NULL AND trim(l1, ' ') || trim(l2, ' ') || trim(l3, ' ') <> ''),
        placed AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS nth FROM windows),
        lost AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM placed, (VALUES (0), (1), (2)) AS o(k) WHERE nth > 1),
        kept AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL) AS text,
                   count(*) AS n_lines, count(x.pos) AS n_removed
            FROM lines l LEFT JOIN lost x USING (doc_id, pos) GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
               CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
        FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op5_chat_format": r"""
        WITH all_rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
            FROM (VALUES (0), (1)) AS t(k)),
        sized AS (
            SELECT *, length(role) + 15
                      + length(replace(replace(replace(text, '\', '\e'), '<turn>', '\o'), '</turn>', '\c')) AS chars
            FROM all_rows),
        running AS (
            SELECT *, sum(chars) OVER c AS upto, lead(turn) OVER c IS NULL AS is_last
            FROM sized WINDOW c AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars,
               count(*) FILTER (WHERE role = 'assistant' OR is_last) AS n_examples
        FROM running GROUP BY conv_id""",
    # Capped sources are those of the smallest cap a weight; the first k of that order stop, the rest share what is left.
    "op7_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM sized GROUP BY source),
        ordered AS (
            SELECT *, sum(source_size) OVER () AS total,
                   coalesce(sum(3 * source_size) OVER before, 0) AS capped,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
                   row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS nth
            FROM sources WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        first_open AS (
            SELECT min(nth) AS nth FROM ordered WHERE (total - capped) * weight < 3 * source_size * open_weight),
        targets AS (
            SELECT o.source, o.source_size,
                   CASE WHEN o.nth < f.nth OR f.nth IS NULL THEN 3.0 * o.source_size
                        ELSE CAST(s.total - s.capped AS DOUBLE) * o.weight / CAST(s.open_weight AS DOUBLE) END AS target
            FROM ordered o CROSS JOIN first_open f LEFT JOIN ordered s ON s.nth = f.nth),
        laid AS (
            SELECT doc_id, source, size,
                   2 * sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5('mix' || doc_id), 1, 13) AS BIGINT), doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS middle
            FROM sized)
        SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 6) AS target,
               CAST(CASE WHEN size = 0 THEN 0
                    ELSE size * greatest(0, ceil((2 * round(target) - middle) / (2.0 * source_size))) END AS BIGINT) AS taken
        FROM laid JOIN targets ON laid.source IS NOT DISTINCT FROM targets.source""",
    "op8_licenses": _license_sql(),
    "op13_repair": _repair_sql(),
}
