"""A corpus pipeline: five operators in a row, each over all that the one before it kept."""

from __future__ import annotations

from tidemark.llm import decontaminate, langid, mixing, similar, toxicity
from tidemark.llm.common import table, written


def identify_language(spark, docs, sf_dir):
    """Documents whose language cannot be told (no text, no letter) go."""
    return langid.keep_identified(docs)


def filter_toxicity(spark, docs, sf_dir):
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Five-word shingles: documents meet by op1's SimHash and pivots, and by MinHash bands beyond its radius, and are linked
    at an exact Jaccard similarity of 0.8 or more.
    """
    return similar.keep_first(docs)


def drop_benchmark_text(spark, docs, sf_dir):
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """How many words the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", filter_toxicity),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
]

# Learned models, fingerprints over XXH64 and components are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to the documents table; each stage's rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
