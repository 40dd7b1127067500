"""Corpus preparation: a sequence of stages over the documents table.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` applies them in order. The stages are
written and read again between runs, so each one reads whole rows of its predecessor; what a stage staged on the way, and its
input, are deleted once its result is written. All but the last keep the columns of documents. There is no SQL for the learnt stages, so ORACLE_SQL is None and the tests hold the result against brute force.
"""

from __future__ import annotations

from functools import wraps

from plumbline.llm import bpe, decontam, neardup, pii, quality
from plumbline.llm.common import Staging, table, temporary_tables

#: What is handed at once to Python. A stage's result is computed when it is written, so the session is set for the whole run.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded(stage):
    """The stage, in a session whose batches are bounded."""

    @wraps(stage)
    def run_stage(spark, docs, sf_dir):
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list = [
    ("quality classifier", bounded(quality.keep_good)),
    ("n-gram Jaccard join", bounded(neardup.keep_first)),
    ("benchmark decontamination", bounded(decontam.drop_contaminated)),
    ("PII", bounded(pii.mask_pii)),
    ("BPE encoding and decoding", bounded(bpe.encode_stage)),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    staging = Staging(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with temporary_tables():
            docs = staging.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            staging.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
