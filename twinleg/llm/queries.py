"""Registered queries of this subpackage: op1 to op13 over whole tables, the pipeline, and oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, embed_dedup, hard_negatives, lz_fingerprint, packing, quality, sanitise, secret_scan, shingle_join, substring_dedup, url_filter, warc
from .spans import span_text


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _counts(spans: str, kinds: list[str]) -> list:
    return [F.expr(f"cast(size(filter({spans}, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds]


def _digest(spans: str, kinds: list[str], by_kind: bool):
    base = F.filter(spans, lambda x: x["kind"].isin(kinds[:-1]))
    return base.alias("base"), span_text("base", kinds, by_kind), span_text(spans, kinds, by_kind).alias("spans")


def _span_query(found: DataFrame, spans: str, kinds: list[str], by_kind: bool) -> DataFrame:
    base, base_text, text = _digest(spans, kinds, by_kind)
    return found.select("doc_id", spans, base).select("doc_id", *_counts(spans, kinds[:-1]), F.sha2(base_text.cast("binary"), 256).alias("base_sha256"), text)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return _span_query(found, "secret_spans", secret_scan.KINDS, by_kind=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, weights).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_next(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_documents(_read(spark, sf_dir, "documents"), 3, (9, 10))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(_read(spark, sf_dir, "embeddings"), 0.93)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return _span_query(found, "pii_spans", sanitise.KINDS, by_kind=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.report(conversation_repair.damaged(rows), rows)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_secret_scans, op2_packing, op3_quality, op4_warc, op5_url_filters, op6_lz_fingerprints, op7_bpe, op8_jaccard_join, op9_embedding_dedup, op10_pii, op11_conversation_repair, op12_substring_dedup, op13_hard_negatives, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    from .oracles import ORACLES

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
