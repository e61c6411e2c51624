"""The operators applied to the test tables: thin queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, kneser, langid, lines, ogg, packing, passages, rollup, simhash
from .runtime import shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.duplicate_passages(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser.fit(docs.where(~langid.held_out(7)))
    return kneser.score(docs, model).select("doc_id", langid.held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(table(spark, sf_dir, "conversations"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded under two tokenizers; then some are deleted, some revised, and one batch comes again."""
    counts = written(rollup.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path()), "token-counts")
    both = {"words": "words", "byte_bpe_50k": "bpe"}
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(0))
    state = rollup.Rollup(spark, f"{shared_dir(spark)}/tessel/rollup-{uuid.uuid4().hex}")
    gone = rollup.as_changes(counts.where(part == 7), "delete", both)
    state.apply("load", rollup.as_changes(counts, "insert", both))
    state.apply("gone", gone)
    state.apply("end-token", rollup.as_changes(counts.where(part == 3), "revise", {"byte_bpe_50k": "bpe"}, {"byte_bpe_50k": 1}))
    state.apply("gone", gone)
    return state.totals()


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_sha256().alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    f = langid.fit(docs.where(~langid.held_out(4)))
    return langid.identify(docs, f).select("doc_id", langid.held_out(4).alias("held_out"), "lang_pred", "score", "known")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.store_and_read(table(spark, sf_dir, "documents")).drop("pages", "bad_pages", "seconds")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_counts": op5_token_counts,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_media_columns": op10_media_columns,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PAD = "lpad(cast(turn as varchar), 12, '0')"

SQL = {
    "op3_line_dedup": rf"""
        WITH split AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
        w AS (
          SELECT doc_id, line_no, regexp_extract_all({_FOLD.format("line")}, '[^\x20\x09-\x0D]+') AS words FROM split),
        l AS (
          SELECT doc_id, line_no, words, len(words) AS n, doc_id * 10000000 + line_no AS spot FROM w WHERE len(words) > 0),
        c AS (SELECT words, min(spot) AS spot, any_value(n) AS n FROM l GROUP BY words),
        v AS (
          SELECT words, spot, p, list_concat(words[1 : p - 1], words[p + 1 : n]) AS cut
          FROM (SELECT words, spot, n, unnest(range(1, n + 1)) AS p FROM c WHERE n >= {lines.MIN_WORDS})),
        sub AS (SELECT words, min(spot) OVER (PARTITION BY cut, p) AS other FROM v),
        ins AS (
          SELECT v.words, c.spot AS other FROM v JOIN c ON v.cut = c.words WHERE c.n >= {lines.MIN_WORDS}
          UNION ALL SELECT c.words, v.spot FROM v JOIN c ON v.cut = c.words WHERE c.n >= {lines.MIN_WORDS}),
        cc AS (SELECT words, spot, array_to_string(words, ' ') AS s FROM c WHERE n < {lines.MIN_WORDS} AND length(array_to_string(words, ' ')) >= {lines.MIN_CHARS}),
        cv AS (
          SELECT words, spot, p, substring(s, 1, p - 1) || substring(s, p + 1) AS cut
          FROM (SELECT words, spot, s, CAST(unnest(range(1, length(s) + 1)) AS BIGINT) AS p FROM cc)),
        csub AS (SELECT words, min(spot) OVER (PARTITION BY cut, p) AS other FROM cv),
        cins AS (
          SELECT cv.words, cc.spot AS other FROM cv JOIN cc ON cv.cut = cc.s
          UNION ALL SELECT cc.words, cv.spot FROM cv JOIN cc ON cv.cut = cc.s),
        best AS (SELECT words, min(other) AS other FROM (SELECT * FROM sub UNION ALL SELECT * FROM ins UNION ALL SELECT * FROM csub UNION ALL SELECT * FROM cins) GROUP BY words),
        k AS (
          SELECT l.doc_id, l.line_no, l.n, l.spot, c.spot AS own, least(c.spot, coalesce(b.other, c.spot)) AS keeper
          FROM l JOIN c ON l.words = c.words LEFT JOIN best b ON l.words = b.words)
        SELECT doc_id, cast(line_no AS integer) AS line_no, cast(n AS integer) AS n_words, keeper // 10000000 AS keeper_doc_id,
          cast(keeper % 10000000 AS integer) AS keeper_line_no, cast(keeper <> own AS integer) AS edits
        FROM k WHERE keeper < spot""",
    "op4_chat_formatting": rf"""
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        k AS (SELECT *, {_PAD} || chr(1) || coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') AS piece FROM t),
        s AS (
          SELECT conv_id, turn, string_agg(piece, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
            row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC, text DESC) AS back_in_turn,
            count(*) OVER (PARTITION BY conv_id) AS n FROM k),
        f AS (SELECT prefix, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies FROM s WHERE back = 1 GROUP BY prefix),
        keep AS (SELECT * FROM f WHERE prefix NOT IN (SELECT prefix FROM s WHERE back > 1 AND back_in_turn = 1))
        SELECT keep.conv_id, n_turns, n_copies,
          string_agg('{chat.OPEN}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{chat.CLOSE}' || chr(10), '' ORDER BY turn, role, text) AS chat
        FROM keep JOIN t ON t.conv_id = keep.conv_id GROUP BY keep.conv_id, n_turns, n_copies""",
    "op6_benchmark_decontamination": rf"""
        WITH dw AS (
          SELECT doc_id, regexp_extract_all(coalesce({_FOLD.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (
          SELECT item_id, regexp_extract_all(coalesce({_FOLD.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
          SELECT item_id, least(len(w), 13) AS n, w[p : p + least(len(w), 13) - 1] AS pat
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS p FROM bw WHERE len(w) > 0)),
        pat AS (SELECT DISTINCT n, pat FROM win),
        sizes AS (SELECT DISTINCT n FROM pat),
        occ AS (
          SELECT doc_id, p, n, w[p : p + n - 1] AS seen
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
        hit AS (SELECT occ.doc_id, occ.p, occ.n, occ.seen FROM occ JOIN pat ON occ.n = pat.n AND occ.seen = pat.pat),
        hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
        it AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT hit.doc_id, cast(win.item_id AS varchar) AS item FROM hit JOIN win ON hit.n = win.n AND hit.seen = win.pat) GROUP BY doc_id)
        SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
