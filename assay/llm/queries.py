"""Registered queries of the corpus operators, over the whole ``documents`` table, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.block_anchors import drop_repeats
from assay.llm.cotraining import VERDICT, score_quality
from assay.llm.exact_dedup import exact_dedup
from assay.llm.hard_negatives import hard_negatives
from assay.llm.katz import katz_scores
from assay.llm.licences import scan_licences, scan_sql
from assay.llm.merkle import build_manifest
from assay.llm.pair_merge import count_tokens
from assay.llm.piece_codec import encode_pieces
from assay.llm.positional_index import decontaminate
from assay.llm.ring_shards import ring_shards
from assay.llm.shingle_join import shingle_join
from assay.llm.tables import documents
from assay.llm.warc import archive_pages, read_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op1_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


@query("op2_katz_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir), pairs_from=1)


@query("op3_positional_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op4_licence_scan", scan_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


@query("op5_piece_codec")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_cotraining")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", f"{VERDICT}.*")


@query("op7_shingle_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(documents(spark, sf_dir))


@query("op8_block_anchors")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_ring_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(documents(spark, sf_dir))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query(
    "op11_hard_negatives",
    """WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label,
            coalesce(list_sum(list_transform(list_zip(a.q, b.q, true), lambda z: z[1] * z[2])), 0)::BIGINT AS score
        FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positive AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    ranked AS (
        SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank
        FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
            AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", turned))


@query(
    "op12_capture_index",
    """WITH p AS (
        SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
            min(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder
        FROM pages WHERE page_id IS NOT NULL)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes < 100 OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN payload_bytes < 100 OR holder = page_id THEN NULL ELSE holder END AS refers_to
    FROM p""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = read_pages(archive_pages(pages), pages.select("page_id", "url").filter("page_id IS NOT NULL"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op13_merkle_manifest",
    """WITH RECURSIVE t AS (
        SELECT list(c ORDER BY i) AS e FROM (
            SELECT i, list_reduce([i] || list_transform(range(8), lambda z: 0::BIGINT),
                lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS i))),
    d AS (
        SELECT row_number() OVER () AS r, *, '1' || coalesce(lang, '') AS tag, lang IS NULL AS bare,
            coalesce(xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT),
                lambda c, z: xor(t.e[xor(c & 255, z) + 1], c >> 8))) % 7 = 0, false) AS hit
        FROM documents, t),
    f AS (
        SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            n_chars::HUGEINT + 1 AS more, coalesce(strlen(text) || ':' || text, '-') AS tail
        FROM d),
    x AS (
        SELECT r, doc_id, lang, bare, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
            CASE WHEN hit THEN sha256(head || coalesce(strlen(more::VARCHAR) || ':' || more::VARCHAR, '-') || tail) END AS bad
        FROM f),
    y AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM x),
    up AS (
        SELECT lang, 0 AS h, i, n, leaf AS g FROM y
        UNION ALL
        SELECT lang, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(g, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, h, n, i // 2),
    s AS (
        SELECT lang, g AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
    lup AS (
        SELECT 0 AS h, i, n, subroot AS g FROM s
        UNION ALL
        SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(g, '' ORDER BY i)) FROM lup WHERE n > 1 GROUP BY h, n, i // 2),
    fold AS (
        SELECT y.r, 0 AS h, y.lang, y.i, y.n, false AS topped, s.i AS j, s.n AS m, coalesce(bad, leaf) AS g, '' AS proof
        FROM y JOIN s ON y.lang IS NOT DISTINCT FROM s.lang
        UNION ALL
        SELECT r, CASE WHEN low THEN h + 1 WHEN topped THEN h + 1 ELSE 0 END, lang,
            CASE WHEN low OR topped THEN i // 2 ELSE j END, CASE WHEN low OR topped THEN (n + 1) // 2 ELSE m END, topped OR NOT low, j, m,
            CASE WHEN NOT low AND NOT topped THEN g WHEN o IS NULL THEN sha256(g) WHEN i % 2 = 1 THEN sha256(o || g) ELSE sha256(g || o) END,
            proof || coalesce(o, '')
        FROM (
            SELECT k.*, NOT k.topped AND k.n > 1 AS low, CASE WHEN k.topped THEN b.g ELSE a.g END AS o
            FROM fold k
            LEFT JOIN up a ON NOT k.topped AND k.n > 1 AND a.lang IS NOT DISTINCT FROM k.lang AND a.h = k.h AND a.i = xor(k.i, 1)
            LEFT JOIN lup b ON k.topped AND b.h = k.h AND b.i = xor(k.i, 1)
            WHERE NOT k.topped OR k.n > 1)),
    ended AS (SELECT r, g, proof FROM fold WHERE topped AND n = 1)
    SELECT y.doc_id, y.leaf, s.subroot, (SELECT g FROM lup WHERE n = 1) AS root, sha256(ended.proof) AS proof_sha256,
        ended.g AS folded_root, ended.g = (SELECT g FROM lup WHERE n = 1) AS verified
    FROM y JOIN s ON y.lang IS NOT DISTINCT FROM s.lang JOIN ended USING (r)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = F.when(hit, more.cast("string")).otherwise(F.col("n_chars").cast("string"))
    proved = build_manifest(docs, {"n_chars": changed}).verify()
    plain = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return proved.select("doc_id", *plain, F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "verified")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
