"""The corpus pipeline: stages over ``documents``, each written and reread as the next one's input."""

from __future__ import annotations

from recordloom.llm import langid, mixing, packing, simhash, templates
from recordloom.storage import stored


def language(spark, docs, sf_dir):
    """Language ID: documents that it rejects go."""
    return langid.accepted(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines whose template recurs across documents go from all documents but the first that has it."""
    return templates.cleaned(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: the one of smallest doc_id.

    Balls around SimHash fingerprints of words and bands of least shingle hashes find the
    pairs, five-word shingles at 0.8 decide on them.
    """
    return simhash.deduplicate(docs)


def mix(spark, docs, sf_dir):
    """Sources mixed to their target weights: one row per document part that the mix takes."""
    return mixing.mixed_documents(docs)


def pack(spark, docs, sf_dir):
    """The parts' tokens packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: No SQL: the stages have no SQL form; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
