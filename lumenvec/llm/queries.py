"""The queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm import (
    chat,
    html_text,
    license_scan,
    line_dedup,
    mixing,
    packing,
    quality_model,
    quality_rules,
    simhash,
    vector_dedup,
)
from lumenvec.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, most=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


SPLICED = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPLICED).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.unionByName(planted)))


def _shown_sql(column: str) -> str:
    return (
        f"(length({column}) + length({column}) - length(replace({column}, chr(92), ''))"
        f" + (length({column}) - length(replace({column}, '###', ''))) // 3"
        f" + (length({column}) - length(replace({column}, '</turn>', ''))) // 7)"
    )


_OP2_SQL = f"""
    WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
               UNION ALL SELECT -7, 0, 'user', '{SPLICED}', NULL UNION ALL SELECT -7, 1, 'assistant', '{SPLICED}', NULL),
    g AS (SELECT conv_id, count(*) AS n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                 sum({len(chat.OPEN + chat.HEAD + chat.CLOSE)} + {_shown_sql("role")} + {_shown_sql("text")})::BIGINT AS formatted_chars
          FROM a GROUP BY conv_id, alone)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, most=2)


_OP3_SQL = f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
    w AS (SELECT *, [5, 2, 1][(k % 3 + 1)::INT]::BIGINT AS weight FROM k),
    p AS (SELECT *, (sum(source_size) OVER ())::BIGINT * 150 / 100 AS total,
                 coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
                 (sum(weight) OVER (ORDER BY 2 * source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights FROM w),
    f AS (SELECT (total - before) AS rest, weights FROM p
          WHERE (total - before) / weights * weight <= 2 * source_size ORDER BY before LIMIT 1),
    t AS (SELECT p.source, k, source_size, least((2 * source_size)::DOUBLE, coalesce(weight * f.rest / f.weights, (2 * source_size)::DOUBLE)) AS target
          FROM p LEFT JOIN f ON true),
    a AS (SELECT coalesce(sum(target), 0) AS total, greatest({mixing.SLOT_WORDS}, floor(coalesce(sum(target), 0) / {mixing.MOST_SLOTS}))::BIGINT AS words FROM t),
    b AS (SELECT *, round(sum(target) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / total * {mixing.CYCLE})::BIGINT AS high FROM t, a),
    r AS (SELECT k, lag(high, 1, 0) OVER (ORDER BY k) AS low, high FROM b),
    q AS (SELECT (slot % {mixing.CYCLE}) * {mixing.STEP} % {mixing.CYCLE} AS point
          FROM (SELECT unnest(range((SELECT floor(total / words)::BIGINT FROM a))) AS slot)),
    n AS (SELECT k, count(*) * (SELECT words FROM a) AS words FROM q JOIN r ON point >= low AND point < high GROUP BY k),
    c AS (SELECT d.doc_id, size, t.k, source_size, target,
                 coalesce(sum(size) OVER (PARTITION BY t.k ORDER BY hash, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (greatest(0, least(size, coalesce(words, 0) - place)) + greatest(0, least(size, coalesce(words, 0) - place - source_size)))::BIGINT AS taken
    FROM c LEFT JOIN n USING (k)"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped_lines")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


_OP5_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT vec_id, label, e, list_inner_product(e, e) AS q FROM v
          WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.q > 0 AND b.q > 0 AND list_inner_product(a.e, b.e) / sqrt(a.q * b.q) >= 0.93),
    r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON vec_id = c.x
    LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON vec_id = k.x"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_stop_words", "n_stop_word_places", "n_upper", "n_digits", "n_short_lines", "base_failed", "kept",
    )


def _op6_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    value = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "distinct_stop_words": "n_stop_words",
        "stop_word_share": "n_stop_word_places / greatest(n_words, 1)",
        "upper_case_share": "n_upper / greatest(word_chars, 1)",
        "digit_share": "n_digits / greatest(word_chars, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "short_line_share": "n_short_lines / greatest(n_lines, 1)",
    }
    tests = " AND ".join(
        f"{value[name]} >= {low}" + ("" if high == float("inf") else f" AND {value[name]} <= {high}")
        for name, low, high in quality_rules.RULES
    )
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    w AS (SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
    n AS (SELECT doc_id, body, lines, words, len(words)::BIGINT AS n_words FROM w),
    g AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS i, words FROM n WHERE n_words >= 8),
    h AS (SELECT doc_id, i, list_aggregate(words[i:i+7], 'string_agg', ' ') AS win FROM g),
    c AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
          FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM c) GROUP BY doc_id),
    m AS (SELECT doc_id, n_words, length(list_aggregate(list_concat([''], words), 'string_agg', ''))::BIGINT AS word_chars,
                 length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 len(lines)::BIGINT AS n_lines,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(lines, lambda l: len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) < {quality_rules.SHORT_LINE}))::BIGINT AS n_short_lines,
                 len(list_distinct(list_filter(regexp_extract_all(lower(body), '[^\x20\x09-\x0D]+'), lambda x: x IN ({stop}))))::BIGINT AS n_stop_words,
                 len(list_filter(regexp_extract_all(lower(body), '[^\x20\x09-\x0D]+'), lambda x: x IN ({stop})))::BIGINT AS n_stop_word_places,
                 length(regexp_replace(body, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
                 length(regexp_replace(body, '[^0-9]+', '', 'g'))::BIGINT AS n_digits
          FROM n LEFT JOIN r USING (doc_id)),
    f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_stop_word_places, n_upper, n_digits, n_short_lines, base_failed,
           NOT base_failed AND {tests} AS kept FROM f"""


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).select(
        "doc_id", F.coalesce(quality_model.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_chat": op2_chat,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_vectors": op5_vectors,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_model": op7_quality_model,
    "op8_license_scan": op8_license_scan,
    "op9_html_extraction": op9_html_extraction,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {
    "op2_chat": _OP2_SQL,
    "op3_mixing": _OP3_SQL,
    "op5_vectors": _OP5_SQL,
    "op6_quality_rules": _op6_sql(),
}
