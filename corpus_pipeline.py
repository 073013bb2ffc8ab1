"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

import uuid

from ledgerview.llm import decontaminate, line_dedup, packing, quality_rules, simhash_dedup
from ledgerview.llm.common import prepare, remove, shared_dir

#: (name, function(spark, docs, sf_dir) -> DataFrame); each stage's result is written and read again by the next one.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

#: Training-free but iterative and tokenizing stages have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over the documents of sf_dir; between stages the rows go to Parquet in the shared folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            remove(spark, before)  # nothing reads it any more
            docs, before = spark.read.parquet(path), path
    return docs
