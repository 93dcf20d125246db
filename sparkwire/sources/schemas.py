"""Table schemas and their additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DUP = "ARRAY<STRUCT<source: STRING, url: STRING, trust_score: DOUBLE, collected_at: STRING, title: STRING>>"
SCHEMAS = {
    "stub": "seq BIGINT, title STRING, url STRING, source STRING, query STRING, pub STRING, snippet STRING",
    "candidate": "seq BIGINT, title_en STRING, url STRING, source STRING, query STRING, pub STRING, article_text STRING, trust_score DOUBLE, trust_matched_domain STRING, case_type STRING",
    "registry": "domain STRING, score DOUBLE",
    "feed_entry": "feed STRING, pos INT, title STRING, link STRING, summary STRING",
    "archive": f"seq BIGINT, article_hash STRING, title STRING, summary_ru STRING, url STRING, source STRING, case_type STRING, trust_score DOUBLE, trust_matched_domain STRING, trust_origin STRING, is_event_news BOOLEAN, relevance_score DOUBLE, relevance_reason STRING, collected_at STRING, dup_sources {DUP}",
    "packages": "seq BIGINT, article_hash STRING, title STRING, url STRING, source STRING, posted_at STRING, collected_at STRING",
    "kb_docs": "id STRING, title STRING, source_type STRING, source_ref STRING, file_ext STRING, mime STRING, size BIGINT, content STRING, tags STRING, author STRING, created_at STRING, updated_at STRING, summary STRING, auto_tags STRING, tldr STRING, enrichment_status STRING, enrichment_error STRING, moderation_status STRING, approved_by STRING, approved_at STRING",
    "kb_hypotheses": "id STRING, statement STRING, rationale STRING, category STRING, confidence DOUBLE, validated INT, evidence_count BIGINT, created_at STRING, run_id STRING, source_kind STRING, lifecycle_status STRING, owner_username STRING, next_check_at STRING, lifecycle_updated_at STRING",
    "kb_hypothesis_sources": "hypothesis_id STRING, doc_id STRING, excerpt STRING, is_origin INT",
    "kb_news_items": "id STRING, title STRING, summary STRING, url STRING, source STRING, origin STRING, case_type STRING, collected_at STRING",
    "kb_insight_runs": "id STRING, started_at STRING, finished_at STRING, status STRING, author STRING, docs_total INT, hypotheses_total INT, validated_total INT, error STRING",
    "kb_insight_docs": "doc_id STRING, first_run_id STRING, processed_at STRING",
    "jobs": "id STRING, user STRING, tier STRING, kind STRING, priority BIGINT, status STRING, phase STRING, payload_json STRING, result_json STRING, error STRING, attempts INT, submitted_at STRING, started_at STRING, finished_at STRING, worker_id STRING, cancel_req INT",
    "job_events": "id BIGINT, job_id STRING, ts STRING, event STRING, detail STRING",
    "state_event": "seq BIGINT, article_hash STRING, user STRING, kind STRING, value STRING, ts TIMESTAMP",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def migrate(df: DataFrame, name: str, defaults: dict | None = None) -> DataFrame:
    """df with every column of the schema: those that it lacks are null or their default."""
    full = empty(df.sparkSession, name)
    missing = [f for f in full.schema.fields if f.name not in df.columns]
    out = df.withColumns({f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in missing}) if missing else df
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in full.schema.fields])


def backfill_moderation(docs: DataFrame) -> DataFrame:
    return docs.withColumn("moderation_status", F.coalesce(F.nullif("moderation_status", F.lit("")), F.lit("approved")))


def backfill_lifecycle(hypotheses: DataFrame) -> DataFrame:
    status = F.when(F.col("validated") == 1, "validated").otherwise("synthesized")
    return hypotheses.withColumn("lifecycle_status", F.coalesce(F.nullif("lifecycle_status", F.lit("")), status))


def backfill_processed(processed: DataFrame, evidence: DataFrame, at: str) -> DataFrame:
    """Documents that evidence names count as processed."""
    new = evidence.select("doc_id").distinct().join(processed, "doc_id", "left_anti")
    return processed.unionByName(new.select("doc_id", F.lit("legacy").alias("first_run_id"), F.lit(at).alias("processed_at")))
