"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, chat, codes, decontaminate, exact_dedup, langid, minhash, pii, quality, secret_scan, sharding, substring_dedup
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """The rank file's path and the pattern, as the installed tokenizer package has them."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def aligned_tokenizers() -> tuple[str, str]:
    """The two vocabularies that op13 aligns."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.report(rows.unionByName(fixed))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), *tokenizer())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"), *aligned_tokenizers())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_pii,
        op2_decontaminate,
        op3_chat,
        op4_byte_bpe,
        op5_sharding,
        op6_near_dedup,
        op7_quality,
        op8_language_id,
        op9_suffix_dedup,
        op10_exact_dedup,
        op11_vector_codes,
        op12_secrets,
        op13_tokenizer_alignment,
    )
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _assigned(books: str) -> str:
    """Each part's nearest entry of some codebooks: vec_id, p, v, e, distance."""
    distance = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - entry[i]) * (v[i] - entry[i])))"
    return f"""SELECT vec_id, p, any_value(v) AS v, min({{'x': distance, 'e': e}}).e AS e, min(distance) AS distance
               FROM (SELECT vec_id, p, v, e, CAST({distance} AS BIGINT) AS distance FROM parts JOIN {books} USING (p)) GROUP BY vec_id, p"""


def _moved(books: str, found: str) -> str:
    """The codebooks after a round: p, e, entry."""
    return f"""SELECT p, e, coalesce(moved, entry) AS entry FROM {books} LEFT JOIN
               (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS moved FROM
                 (SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM {found}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY p, e, i)
                GROUP BY p, e) USING (p, e)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            bi AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
                   FROM b WHERE len(w) > 0),
            bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM bi),
            di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                   FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
            hits AS (SELECT doc_id, i, bw.k AS k, item
                     FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM di) x
                     JOIN bw ON bw.k = x.k AND bw.win = x.win),
            words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                      FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
            SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
            FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op3_chat": r"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
                         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM c)
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(length(regexp_replace(role || text, '([\\#<:])', 'xx', 'g')) + 14)::BIGINT AS formatted_chars,
                   bool_and(CASE WHEN role = 'system' THEN n = 1
                                 WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                                 WHEN role = 'assistant' THEN before = 'user' ELSE false END
                            AND (NOT last OR role = 'assistant')) AS valid
            FROM o GROUP BY conv_id""",
        "op11_vector_codes": f"""
            WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
                          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            parts AS (SELECT vec_id, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v FROM kept, range(16) AS t(p)),
            seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
            c0 AS MATERIALIZED (SELECT p, e, v AS entry FROM seeds JOIN parts USING (vec_id)),
            a0 AS MATERIALIZED ({_assigned("c0")}), c1 AS MATERIALIZED ({_moved("c0", "a0")}),
            a1 AS MATERIALIZED ({_assigned("c1")}), c2 AS MATERIALIZED ({_moved("c1", "a1")}),
            a2 AS MATERIALIZED ({_assigned("c2")}),
            coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(distance)::BIGINT AS error FROM a2 GROUP BY vec_id)
            SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
                   (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
            FROM coded JOIN kept USING (vec_id)""",
        "op10_exact_dedup": r"""
            WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                              sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
            g AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
                         count(*) OVER (PARTITION BY h) AS group_size FROM k)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
    }
