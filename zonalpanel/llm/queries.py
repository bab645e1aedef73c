"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import public_tokenizers

from zonalpanel.session import scratch_dir

from . import (
    bpe,
    byte_bpe,
    embedding_dedup,
    lexical,
    licenses,
    line_dedup,
    near_dedup,
    packing,
    periodic_runs,
    quality,
    substring_dedup,
    toxicity,
    warc,
)
from .common import settled, sha256_text, table


VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = public_tokenizers.path(VOCABULARY)
    result = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return result.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        sha256_text("decoded_text").alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web archives and read back."""
    path = scratch_dir(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = settled(warc.read_archive(spark, path).drop("payload", "target_uri"), "records")
    return warc.resolved(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (toxicity.remainder() == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without word windows seen earlier, as digests."""
    result = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_words", "n_removed", sha256_text("kept_text").alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that a later document holds too, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    result = line_dedup.drop_shared_lines(docs)
    return result.select("doc_id", "n_lines", "n_dropped", sha256_text("kept_text").alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-equal documents of every document."""
    result = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "class_id", F.col("keeper").alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures of every document and whether it is kept."""
    result = quality.judge(table(spark, sf_dir, "documents"))
    return result.drop("line_share", "gram_shares")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, with runs planted in a tenth of them."""
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    found = periodic_runs.find_runs(docs)
    line = F.transform(
        "runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    )
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        sha256_text(lines).alias("runs_sha256"),
        sha256_text("collapsed_text").alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into byte-level tokens and decoded again, as digests."""
    path = public_tokenizers.path(BYTE_RANKS)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    result = byte_bpe.decode(encoded, path, public_tokenizers.PATTERN)
    return result.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_warc,
        op3_toxicity,
        op4_substring_dedup,
        op5_line_dedup,
        op6_license_scan,
        op7_best_fit_packing,
        op8_near_dedup,
        op9_quality_rules,
        op10_embedding_dedup,
        op11_periodic_runs,
        op12_lexical_search,
        op13_byte_bpe,
    )
}

CHECKS: dict[str, str] = {
    "op2_warc": """
        WITH hashed AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), first AS (
            SELECT hex, min(page_id) AS first_page FROM hashed GROUP BY hex
        )
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + list_aggregate(list_transform(range(5), lambda j:
                    (((position(substr(hex, CAST((5 * i + j) // 4 + 1 AS BIGINT), 1) IN '0123456789abcdef') - 1)
                        >> CAST(3 - (5 * i + j) % 4 AS BIGINT)) & 1) << CAST(4 - j AS BIGINT)), 'sum')::BIGINT, 1)),
                'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_page THEN first_page END AS refers_to,
            CAST(NULL AS VARCHAR) AS problem
        FROM hashed JOIN first USING (hex)
    """,
    "op4_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS key
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split WHERE len(words) >= 20)
        ), first AS (
            SELECT key, min(struct_pack(doc := doc_id, at := i)) AS source FROM windows GROUP BY key HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p
            FROM windows JOIN first USING (key) WHERE NOT (source.doc = doc_id AND source.at = i)
        ), words AS (
            SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM split
        ), kept AS (
            SELECT w.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS kept
            FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
    "op5_line_dedup": """
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS position FROM split
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), shared AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT k.doc_id, k.position, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
            FROM keyed k LEFT JOIN shared s USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE vectors AS MATERIALIZED (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach(u, v) AS (
            SELECT vec_id, vec_id FROM vectors
            UNION
            SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
        ), component AS (
            SELECT u, min(v) AS low FROM reach GROUP BY u
        )
        SELECT e.vec_id, count(l.v) AS n_links, any_value(c.low) AS component_id, e.vec_id = any_value(c.low) AS kept
        FROM embeddings e JOIN component c ON c.u = e.vec_id LEFT JOIN links l ON l.u = e.vec_id
        GROUP BY e.vec_id
    """,
    "op12_lexical_search": r"""
        WITH lowered AS (
            SELECT row_number() OVER () AS r, doc_id,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), split AS (
            SELECT r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM lowered
        ), totals AS (
            SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM split
        ), postings AS (
            SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
            FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM split) GROUP BY r, term
        ), held AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN totals
        ), wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), parts AS (
            SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words)))) AS part
            FROM postings JOIN held USING (term) CROSS JOIN totals
        ), scored AS (
            SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(part) AS BIGINT) AS score
            FROM parts JOIN wanted USING (term) GROUP BY item_id, r
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
