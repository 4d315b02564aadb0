"""The queries of this subpackage, each over its whole table; the operators keep their own interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from featureflow.llm import bpe, clustering, conversation_repair, html_text, licenses, line_dedup, packing, pii, quality, secret_scan, simhash, vectors, warc
from featureflow.sources.storage import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), words=3, distance=3)


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    written = warc.write_warc(_table(spark, folder, "pages"), scratch_path(spark, "warc"), min_bytes=0)
    records = warc.read_warc(written, payloads=False)
    return records.select(
        F.col("fields")["page"].cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("fields")["refers-to-page"].cast("long").alias("refers_to"),
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.assess(_table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")
    base = ("assign", "access", "hex")
    count = lambda n: F.size(F.filter("secret_spans", lambda x: x["name"] == n)).cast("long")
    counts = [count(n).alias(f"n_{n}") for n in base]
    digest = F.sha2(told(F.filter("secret_spans", lambda x: x["name"].isin(*base))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, told("secret_spans").alias("spans"))


def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, folder, "documents").select("doc_id", "text", F.col("text").alias("whole")))
    count = lambda c: F.when(F.length(c) > 0, F.size(F.split(c, "\n"))).otherwise(0).cast("long")
    return kept.select("doc_id", count("whole").alias("n_lines"), count("text").alias("n_kept"), F.sha2("text", 256).alias("text_sha256"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op8_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, folder, "embeddings"), cosine=0.9)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(_table(spark, folder, "documents"))
    names = F.array(*map(F.lit, (*pii.KINDS, pii.TERM)))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    base = F.sha2(told(F.filter("spans", lambda x: x["kind"] < len(pii.KINDS))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, told("spans").alias("spans"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(_table(spark, folder, "embeddings"), size=64)


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), ids=rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_secrets": op5_secrets,
    "op6_lines": op6_lines,
    "op7_licenses": op7_licenses,
    "op8_vectors": op8_vectors,
    "op9_packing": op9_packing,
    "op10_html": op10_html,
    "op11_pii": op11_pii,
    "op12_centroids": op12_centroids,
    "op13_conversations": op13_conversations,
}

def _clustered_sql(clusters: int = 8, rounds: int = 10) -> str:
    """The rounds of op12 as common table expressions: a0, c1, a1, ..., the last assignment."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = 64),
        c0 AS MATERIALIZED (
            SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INT AS c, v FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {clusters})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
            SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best
            FROM (SELECT kept.*, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
                  FROM kept CROSS JOIN c{r})
            GROUP BY i)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
                SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
                    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS v
                    FROM (SELECT c, p, sum(x) AS s, count(*) AS n
                          FROM (SELECT best.c AS c, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM a{r}) GROUP BY c, p)
                    GROUP BY c) m ON m.c = c{r}.c)"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
               (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c"""


ORACLE: dict[str, str] = {
    "op12_centroids": _clustered_sql(),
    "op2_warc": """
        WITH pages_ AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        hashed AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM pages_),
        fives AS (
            SELECT page_id, payload_bytes, hex,
                   list_transform(range(8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::INT) AS parts
            FROM hashed),
        coded AS (
            SELECT page_id, payload_bytes,
                   array_to_string(list_transform(range(32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[(1 + i // 4)::INT] >> (15 - 5 * (i % 4))::INT) & 31), 1)), '')
                       AS payload_digest
            FROM fives),
        kept AS (SELECT payload_digest, max(page_id) AS keeper FROM coded GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
        FROM coded JOIN kept USING (payload_digest)
    """,
}
