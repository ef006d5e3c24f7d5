"""The operators' queries over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from fleetspark.llm.base import read
from fleetspark.llm.brown import class_scores
from fleetspark.llm.chat import formatted_chats
from fleetspark.llm.exact import exact_duplicates
from fleetspark.llm.htmltext import page_texts
from fleetspark.llm.langid import page_languages
from fleetspark.llm.lines import line_rules
from fleetspark.llm.merkle import merkle_manifest
from fleetspark.llm.minhash import near_duplicates
from fleetspark.llm.packing import pack
from fleetspark.llm.quality import quality_scores
from fleetspark.llm.spiece import encoded
from fleetspark.llm.substring import repeated_runs
from fleetspark.llm.variants import spelling_variants


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; FLEETSPARK_TOKENIZERS overrides the folder."""
    folder = os.environ.get("FLEETSPARK_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(read(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted_chats(read(spark, sf_dir, "conversations"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_html_extraction": op13_html_extraction,
}

ORACLES = {
    "op1_substring_dedup": r"""
        WITH t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ),
        windows AS (
            SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM t)
        ),
        again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM windows SEMI JOIN again USING (s)
        ),
        lost AS (SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(lost), 0) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: lost IS NULL OR NOT list_contains(lost, i)), ' ')) AS kept_sha256
        FROM t LEFT JOIN lost USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(n) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY n)
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)
        ),
        rows AS (
            SELECT *, (SELECT xor(list_reduce([4294967295] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))),
                                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) FROM crc) % 7 = 0 AS struck
            FROM documents
        ),
        coded AS (
            SELECT doc_id, lang, struck, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
                   coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM rows
        ),
        leaves AS (SELECT doc_id, lang, sha256(head || size || tail) AS leaf, sha256(head || CASE WHEN struck THEN more ELSE size END || tail) AS checked FROM coded),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
        level AS (
            SELECT lang, 0 AS lvl, pos, leaf AS node FROM placed
            UNION ALL
            SELECT lang, lvl + 1, pos // 2, string_agg(node, '' ORDER BY pos)
            FROM (SELECT *, max(pos) OVER (PARTITION BY lang) AS last FROM (SELECT lang, lvl, pos, CASE WHEN lvl = 0 THEN node ELSE sha256(node) END AS node FROM level))
            WHERE last > 0 GROUP BY lang, lvl, pos // 2
        ),
        nodes AS (SELECT lang, lvl, pos, CASE WHEN lvl = 0 THEN node ELSE sha256(node) END AS node, max(lvl) OVER (PARTITION BY lang) AS depth FROM level),
        subroots AS (
            SELECT lang, node AS subroot, depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE lvl = depth
        ),
        above AS (
            SELECT 0 AS lvl, pos, subroot AS node FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 2, string_agg(node, '' ORDER BY pos)
            FROM (SELECT *, max(pos) OVER () AS last FROM (SELECT lvl, pos, CASE WHEN lvl = 0 THEN node ELSE sha256(node) END AS node FROM above))
            WHERE last > 0 GROUP BY lvl, pos // 2
        ),
        tops AS (SELECT lvl, pos, CASE WHEN lvl = 0 THEN node ELSE sha256(node) END AS node, max(lvl) OVER () AS depth FROM above),
        steps AS (
            SELECT p.lang, p.pos, n.lvl AS step, (p.pos >> n.lvl) & 1 AS odd, s.node AS sibling
            FROM placed p JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.pos = p.pos >> n.lvl AND n.lvl < n.depth
            LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = n.lvl AND s.pos = xor(n.pos, 1)
            UNION ALL
            SELECT p.lang, p.pos, r.depth + n.lvl, (r.pos >> n.lvl) & 1, s.node
            FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
            JOIN tops n ON n.pos = r.pos >> n.lvl AND n.lvl < n.depth
            LEFT JOIN tops s ON s.lvl = n.lvl AND s.pos = xor(n.pos, 1)
        ),
        proofs AS (SELECT lang, pos, string_agg(coalesce(sibling, ''), '' ORDER BY step) AS proof, count(*) AS n FROM steps GROUP BY lang, pos),
        fold AS (
            SELECT lang, pos, 0 AS step, checked AS h FROM placed
            UNION ALL
            SELECT f.lang, f.pos, f.step + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.odd = 1 THEN s.sibling || f.h ELSE f.h || s.sibling END)
            FROM fold f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.step = f.step
        ),
        ends AS (SELECT lang, pos, arg_max(h, step) AS folded_root FROM fold GROUP BY lang, pos)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
        CROSS JOIN (SELECT node AS root FROM tops WHERE lvl = depth)
        LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos
        JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.pos = p.pos
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)
        ),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
        ),
        counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS tagged, run, count(*) AS n FROM runs GROUP BY ALL),
        summed AS (
            SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(1, strlen(tagged) + 1), lambda k: ('0x' || substr(hex(encode(tagged)), 2 * k - 1, 2))::BIGINT),
                                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM counted, crc
        ),
        words AS (
            SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ),
        short AS (SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM words)),
        pairs AS (
            SELECT a.word, b.word AS other FROM short a JOIN short b USING (p, rest) WHERE a.word <> b.word
            UNION SELECT a.word, b.word FROM short a JOIN words b ON b.word = a.rest
            UNION SELECT b.word, a.word FROM short a JOIN words b ON b.word = a.rest
        ),
        near AS (
            SELECT p.word, count(*) AS n_near, min((-o.n, p.other)) AS best FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
        ),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
            FROM words w LEFT JOIN near USING (word)
        ),
        chain AS (
            SELECT word, word AS place, 0 AS step FROM words
            UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.place WHERE f.form IS NOT NULL
        )
        SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n
        FROM forms JOIN (SELECT word, arg_max(place, step) AS root FROM chain GROUP BY word) USING (word)
    """,
}
