"""The thin queries of the operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_documents
from tidemark.llm.common import importable, shared_dir
from tidemark.llm.fingerprint import fingerprints
from tidemark.llm.html_text import main_text
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix, mix_sql
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.quality import classify
from tidemark.llm.token_store import read_store, write_store
from tidemark.llm.top_k import top_k
from tidemark.llm.warc import read_warc, write_warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex[:12]}"
    write_warc(table(spark, sf_dir, "pages"), top)
    found = read_warc(spark, top)
    same = F.col("payload_digest") == F.col("told")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "rate", "sampled")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "removed")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = f"{shared_dir(spark)}/store-{uuid.uuid4().hex[:12]}"
    write_store(table(spark, sf_dir, "documents"), tokenizer(), top)
    return read_store(spark, top)


def op6_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS master FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> master THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> master THEN master END AS refers_to FROM m"""
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
h AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM s), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 75 * (m.n + o.n - k)),
r(doc_id, other) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) USING (doc_id)"""
QUERIES = {f.__name__: f for f in (op1_warc_boundary_chain, op2_mixing, op3_line_dedup, op4_quality_classifier, op5_token_store, op6_norm_bucket_top_k, op7_tag_path_ratios, op8_bpe_transducer, op9_multiset_fingerprint, op10_minhash_near_dedup)}
ORACLES: dict[str, str] = {"op1_warc_boundary_chain": WARC_SQL, "op2_mixing": mix_sql(), "op6_norm_bucket_top_k": TOP_K_SQL, "op10_minhash_near_dedup": NEAR_SQL}
