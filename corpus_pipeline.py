"""The corpus pipeline: stages over `documents`, each written and read by the next.

A stage takes (spark, docs, folder of tables) and works on all that the one before it
kept; all but the last return the columns of `documents`.
"""

import public_tokenizers
from pyspark.sql import functions as F

from fleetmeter.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from fleetmeter.sources.staging import staged

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark, docs, sf_dir):
    """Documents the toxicity model does not reject; it learns from the labelled rows of `docs`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, learnable=lambda known: toxicity.fold_of("id", 3) != 1)
    scored = toxicity.scored(docs, model)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark, docs, sf_dir):
    """Documents without lines and sentences that an earlier document has.

    Documents of which nothing is left go; `n_chars` follows the text.
    """
    kept = line_dedup.without_repetition(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def keep_one_of_each_group(spark, docs, sf_dir):
    """The document of the smallest id of each group of near copies.

    Rows are told apart by id alone: repeated rows of one id all stay, and so do rows without an id.
    """
    found = ngram_join.joined(docs)
    copies = found.where("component <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminated(docs, benchmark)
    return found.where(F.size("hit_words") == 0).select("row.*")


def encode(spark, docs, sf_dir):
    """Token ids of every document left, and digests of them and of the decoded text."""
    found = bpe.encoded(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# Trained scores and token ids have no SQL; the tests compare with plain computations.
ORACLE_SQL = None


def run(spark, sf_dir):
    """`documents` through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
