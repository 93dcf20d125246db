"""A corpus in five stages, each an operator of sparkwire.llm over all that the stage before kept.

Each stage's cases are those of its operator: null and empty texts are `und` and go with the first stage;
rows that repeat a doc_id, or have none, are judged each by its own text, but for line dedup, where they
are one document; of equal rows one stays after near-dedup; an empty table gives an empty one, and an
empty benchmark removes nothing. Tables of stages are dropped when the next is written, or when one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkwire.llm import decontam, jaccard, langid, linededup, packing, simhash
from sparkwire.llm.common import fresh, shared_folder, table
from sparkwire.sources import sinks


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = (fresh("__lines", docs), fresh("__dropped", docs))
    return linededup.dedup_lines(docs, counts=counts).select([f"`{c}`" for c in docs.columns])


#: Texts go to Python in batches of so many rows: executors hold each batch outside their heap, growing it by doubling.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _batched(stage):
    """The stage, with the session's batches of BATCH_ROWS rows at most."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language id", lambda spark, docs, sf_dir: langid.keep_identified(docs)),
    ("line dedup", _lines),
    ("simhash near-dedup", lambda spark, docs, sf_dir: simhash.keep_one(docs, jaccard.SIMILARITY)),
    ("decontamination", lambda spark, docs, sf_dir: decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]
STAGES = [(name, _batched(stage)) for name, stage in STAGES]
#: No SQL: fingerprints, tokenizer ids and the language model are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again.

    A stage's table goes once the next one is written; the last stays, for the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    rows = spark.conf.get(_BATCH)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{k}")
            if k:
                sinks.drop(spark, f"{folder}/{k - 1}")
            docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    except BaseException:
        sinks.drop(spark, folder)
        raise
    finally:
        spark.conf.set(_BATCH, rows)
    return docs
