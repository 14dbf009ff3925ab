"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacloom.llm import binary, chat, decontaminate, jaccard, knn, lexical, mixing, negatives, oracles, packing, pii, quality, secrets, suffixes
from vacloom.llm.common import table, word_count


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.classes(table(spark, sf_dir, "documents"), jaccard.Similarity(3, 90, 100))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    book = quality.ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.verdict(quality.BASE_POLICY)).alias("base_failed"),
        quality.verdict(quality.STRICT_POLICY).alias("kept"), "fail_bits",
    )


def op3_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binary.read_shards(binary.write_shards(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return secrets.secret_scan(docs, owner=F.col("source"), repository=F.col("lang"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_words", "start", "end")


def op9_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", word_count(docs["text"]).alias("_m_size"))
    return mixing.mixed(sizes).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"),
        F.col("mix_copies").alias("copies"), F.col("mix_rate").alias("rate"),
    )


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.written_records(chat.prefix_target(given.unionByName(own))))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_rules": op2_quality_rules,
    "op3_packed_windows": op3_packed_windows,
    "op4_personal_data": op4_personal_data,
    "op5_voronoi_knn": op5_voronoi_knn,
    "op6_token_files": op6_token_files,
    "op7_secret_scan": op7_secret_scan,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_mixed_sources": op9_mixed_sources,
    "op10_prefix_targets": op10_prefix_targets,
    "op11_lexical_search": op11_lexical_search,
    "op12_decontamination": op12_decontamination,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE = {
    "op1_ngram_jaccard": oracles.jaccard_sql(jaccard.Similarity(3, 90, 100)),
    "op2_quality_rules": oracles.quality_sql(),
    "op8_repeated_passages": oracles.passages_sql(),
    "op10_prefix_targets": oracles.chat_sql(),
    "op11_lexical_search": oracles.lexical_sql(),
    "op12_decontamination": oracles.contamination_sql(),
    "op13_hard_negatives": oracles.negatives_sql(),
    "op5_voronoi_knn": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
