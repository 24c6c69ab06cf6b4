"""Registered queries of this folder, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op3_simhash_golay")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.simhash import near_duplicates

    rows = near_duplicates(table(spark, sf, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query(
    "op8_warc_normaliser",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
      CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN keeper <> page_id THEN keeper END AS refers_to
    FROM p LEFT JOIN k USING (d)
    """,
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.warc import archive_roundtrip

    rows = archive_roundtrip(table(spark, sf, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op10_poisson_mix",
    """
    WITH s AS (SELECT source, sum(length(coalesce(text, ''))) AS units FROM documents GROUP BY source),
    w AS (SELECT source, units, CASE WHEN units > 0 THEN sqrt(units) ELSE 0 END AS w FROM s),
    r AS (SELECT source, w * ((SELECT sum(units) FROM w) / (SELECT sum(w) FROM w)) / units AS rate FROM w WHERE units > 0),
    q AS (SELECT source, greatest(ceil(rate / 8), 1)::INT AS pieces, rate / greatest(ceil(rate / 8), 1) AS m FROM r),
    c AS (SELECT source, pieces, j, sum(exp(j * ln(m) - m - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS cdf
      FROM q, generate_series(0, 64) AS g(j)),
    u AS (SELECT doc_id, source, i, ('0x' || substr(md5('17:' || doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM documents JOIN q USING (source), generate_series(1, pieces) AS g(i)),
    n AS (SELECT u.doc_id, count(c.j) AS n FROM u JOIN c ON u.source = c.source AND c.cdf <= u.u GROUP BY u.doc_id)
    SELECT d.*, g.copy::BIGINT AS copy FROM documents d JOIN n USING (doc_id), generate_series(1, n) AS g(copy)
    """,
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.mixing import poisson_replicate

    return poisson_replicate(table(spark, sf, "documents"))


@query("op1_scaled_fingerprints")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf, "documents"))


def tokenizer_path() -> str:
    """The public tokenizer file; every node has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_token_frames")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.tokens import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf, "documents"), tokenizer_path()))


@query("op5_benchmark_bm25")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.decontaminate import contaminated

    rows = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.withColumnRenamed("id", "doc_id")


@query("op7_license_templates")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.licenses import scan_licenses

    rows = scan_licenses(table(spark, sf, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


TOXIC_FROM = 0.3


@query("op4_toxic_neighbours")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.toxicity import fit, is_held_out, score_documents

    docs = table(spark, sf, "documents")
    rows = score_documents(docs, fit(docs, table(spark, sf, "labels")))
    return rows.select(
        F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.array_join(F.transform("evidence", lambda e: e["example"].cast("string")), ",").alias("evidence"),
    )


@query("op9_markov_secrets")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.secrets import secret_digest

    rows = secret_digest(table(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


@query("op6_deleted_interpolation")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.language_model import score_documents

    return score_documents(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op11_virtual_slots", statements.OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.sharding import LAW, shard_documents, size_of

    text = F.coalesce(F.col("record.text"), F.lit(""))
    return shard_documents(table(spark, sf, "documents")).select(
        F.col("record.doc_id").alias("doc_id"), size_of(F.col("record.text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"), "shard",
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"),
    )


@query("op12_prefix_trie", statements.OP12)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.prefix_trie import prefix_trie, with_host_turns

    return prefix_trie(*with_host_turns(table(spark, sf, "conversations")))


@query("op13_integer_clusters", statements.OP13)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.llm.centroids import centroid_digest, cluster

    rows = cluster(table(spark, sf, "embeddings"))
    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        centroid_digest(F.col("centroid")).alias("centroid_sha256"),
    )
