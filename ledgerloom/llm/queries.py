"""The operators over the sample tables, as named queries; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat, divergence, jaccard, line_dedup, mixing, packing, quality_model, substrings, tokens, vantage, warc, whitening
from ledgerloom.llm.quality_rules import BLANK, BOILERPLATE, SYMBOL, Rules, clean_lines
from ledgerloom.llm.shared import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


_RULES = Rules()
_PHRASES = "|".join(p.replace(" ", f"{BLANK}+") for p in BOILERPLATE)


@query(rf"""
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
), lines AS (
    SELECT doc_id, row, i, line, len(words) AS n, length(line) - length(regexp_replace(line, '{SYMBOL}+', '', 'g')) AS symbols
    FROM (
        SELECT doc_id, row, i, split[i] AS line, list_filter(string_split_regex(split[i], '{BLANK}+'), lambda x: x <> '') AS words
        FROM (SELECT *, unnest(range(1, len(split) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS split FROM texts))
    )
), judged AS (
    SELECT *, n > 0 AND (
        symbols > {_RULES.symbols} * n
        OR n <= {_RULES.boilerplate_words} AND regexp_matches(line, '(?i)(^|[^a-zA-Z])({_PHRASES})($|[^a-zA-Z])')
        OR n >= {_RULES.shout_words} AND length(line) - length(regexp_replace(line, '\p{{Lu}}+', '', 'g')) > {_RULES.shouted} * length(line)
        OR length(line) - length(regexp_replace(line, '[[:punct:]]+', '', 'g')) > {_RULES.punctuation} * length(line)
    ) AS fails FROM lines
), by_text AS (
    SELECT row, sum(n) AS n_words, sum(symbols) AS n_symbols, count(*) FILTER (WHERE n > 0) AS n_lines,
           count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
           count(*) FILTER (WHERE fails) AS n_bad_lines, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS n_kept_words
    FROM judged GROUP BY row
), grams AS (
    SELECT row, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS gram
    FROM (
        SELECT row, words, unnest(range(1, len(words) - 1)) AS k
        FROM (SELECT row, list_filter(string_split_regex(text, '{BLANK}+'), lambda x: x <> '') AS words FROM texts)
    )
), repeated AS (
    SELECT row, count(DISTINCT k + step) AS n_repeat_words
    FROM (SELECT *, count(*) OVER (PARTITION BY row, gram) AS times FROM grams), (VALUES (0), (1), (2)) AS steps(step)
    WHERE times > 1 GROUP BY row
), counted AS (
    SELECT doc_id, by_text.*, length(regexp_replace(text, '{BLANK}+', '', 'g')) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM texts JOIN by_text USING (row) LEFT JOIN repeated USING (row)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_bad_lines AS BIGINT) AS n_bad_lines, CAST(n_kept_words AS BIGINT) AS n_kept_words,
       n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
       NOT base_failed AND n_words - n_kept_words <= {_RULES.max_lost} * n_words AS kept
FROM counted
""")
def op1_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        "n_bad_lines",
        "n_kept_words",
        "base_failed",
        "kept",
    )


@query()
def op2_interval_expansion_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substrings.repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select(
        "doc_id",
        "n_bytes",
        lengths.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


@query()
def op4_naive_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality_model.score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query()
def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query(rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{BLANK}+'), lambda x: x <> '') AS words
    FROM documents
), sets AS (
    SELECT DISTINCT doc_id, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM texts)
    UNION ALL
    SELECT doc_id, array_to_string(words, ' ') FROM texts WHERE len(words) BETWEEN 1 AND 2
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), meetings AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
    FROM sets AS a JOIN sets AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM meetings JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
    WHERE 100 * overlap >= 90 * (x.n + y.n - overlap)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN sizes USING (doc_id)
""")
def op6_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op7_deletion_neighbourhood_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


@query()
def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = mixing.word_count(F.col("text")).alias("words")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words)
    return mixing.mix(docs, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


_CONTROLS = "|".join(["\\\\", *(c.replace("[", "\\[").replace("]", "\\]") for c in chat.CONTROLS)])
_MARKS = " ".join(f"WHEN '{role}' THEN {len(before) + len(after)}" for role, (before, after) in chat.MARKS.items())


@query(rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), rendered AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + CASE role {_MARKS}
           ELSE {sum(map(len, chat.OTHER))} + length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
""")
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_conversations(chat.events_of(turns)))


@query("""
WITH vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM vectors AS q JOIN vectors AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op10_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vantage.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query()
def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    by_component = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    return whitened.select("vec_id", "n", "deviation", "identity_error", by_component).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("of.whitened").alias("whitened"),
        F.col("of.explained").alias("explained"),
        "identity_error",
    )


@query(rf"""
WITH texts AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x{{00}}-\x{{40}}\x{{5B}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS terms
    FROM documents
), occurring AS (
    SELECT doc, lang, source, unnest(terms) AS term FROM texts
), kept AS (
    SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT doc) >= {divergence.LEAST_DOCUMENTS}
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM texts
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
    SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), of_lang AS (
    SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL
), lang_totals AS (
    SELECT lang, sum(n) AS total FROM counts GROUP BY lang
), cells AS (
    SELECT lang, source, term, coalesce(n, 0) AS n,
           1 + ({divergence.SCALE} * CAST(coalesce(n, 0) + {divergence.SMOOTHING} AS HUGEINT)) // CAST(total + {divergence.SMOOTHING} * v AS HUGEINT) AS p
    FROM totals JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce((
        SELECT sum(abs(x.p - y.p)) FROM cells AS x JOIN cells AS y USING (lang, term)
        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source
    ), 0) AS value
    FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
    SELECT lang, source, term AS item,
           p - (1 + ({divergence.SCALE} * CAST(of_lang.n + {divergence.SMOOTHING} AS HUGEINT)) // CAST(lang_totals.total + {divergence.SMOOTHING} * v AS HUGEINT)) AS value
    FROM cells JOIN of_lang USING (lang, term) JOIN lang_totals USING (lang) JOIN sizes USING (lang) WHERE cells.n > 0
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms WHERE value > 0
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
""")
def op12_transducer_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("""
WITH records AS (
    SELECT page_id, row_number() OVER () AS record, coalesce(html, '') AS payload FROM pages
), responses AS (
    SELECT payload, max(struct_pack(page_id := coalesce(page_id, -9223372036854775808), record := record)) AS response FROM records GROUP BY payload
), coded AS (
    SELECT page_id, record, response, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM records JOIN responses USING (payload)
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST(concat('0x', substr(hex, 1 + 5 * (k // 4), 5)) AS INTEGER) >> (15 - 5 * (k % 4))) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN record = response.record THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN record <> response.record THEN response.page_id END AS refers_to
FROM coded
""")
def op13_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
