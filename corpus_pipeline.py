"""A training-text pipeline of five stages; each works on all that the one before it kept.

A stage is a function of (spark, docs, folder of the tables) and returns a frame. ``run`` writes
each stage as Parquet into the folder all executors share and reads it again for the next one,
so a lost executor costs no earlier stage. A stage's files go once the next one is written; the
last stage's stay, for they are the result.
"""

from functools import wraps

import public_tokenizers

from mailgrid.llm import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    sentencepiece_codec,
)
from mailgrid.llm.common import reachable, remove_folder, table
from mailgrid.session import work_folder


def stage(build):
    @wraps(build)
    def run_stage(spark, docs, sf_dir):
        reachable(spark)
        return build(spark, docs, sf_dir)

    return run_stage


@stage
def known_language(spark, docs, folder):
    """Drops texts without a letter and those no learned language explains."""
    return language_id.keep_known_languages(docs)


@stage
def exact_duplicates(spark, docs, folder):
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


@stage
def near_duplicates(spark, docs, folder):
    """Of documents that links of five-word shingles with a similarity of 0.8 or more connect,
    the one with the smallest doc_id stays."""
    return jaccard_join.drop_near_duplicates(docs, k=5, percent=80)


@stage
def benchmark_leaks(spark, docs, folder):
    """Drops documents that hold most of a benchmark item, in whatever order."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


@stage
def encoded(spark, docs, folder):
    """The ids of the texts that are left."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_texts(docs, path)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_duplicates),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", encoded),
]

# SQL cannot state language, tiling and piece models; tests compare with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """doc_id, ids, n_ids, round_trip of the documents that all stages keep."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = work_folder(spark, "pipeline")
    for name, build in STAGES:
        build(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
