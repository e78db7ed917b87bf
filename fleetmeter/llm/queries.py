"""The operators as queries over the given tables: name -> f(spark, folder)."""

import public_tokenizers
from pyspark.sql import functions as F

from fleetmeter.llm import (
    bpe, decontamination, license_scan, line_dedup, merkle, neighbours, ngram_join, personal_data, quality,
    quality_rules, ranked_search, toxicity, url_filters,
)

QUERIES = {}
VOCABULARY = "word_bpe_49k.json"


def query(function):
    """Registers f(spark, folder) under its own name."""
    QUERIES[function.__name__] = function
    return function


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _score_columns(id_column, parts, held_out, score, threshold):
    remainder = toxicity.fold_of(id_column, parts)
    return [
        F.col(id_column).alias("doc_id"),
        F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
    ]


@query
def op1_license_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = license_scan.scanned(docs)
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        license_scan.labelled(base).alias("base_labels"),
        license_scan.labelled(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


@query
def op2_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"),
                           learnable=lambda known: toxicity.fold_of("id", 3) != 1)
    found = toxicity.scored(docs, model).select("row.doc_id", "score")
    return found.select(*_score_columns("doc_id", 3, 1, F.col("score"), toxicity.THRESHOLD))


@query
def op3_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.decontaminated(docs, table(spark, folder, "benchmark"))
    n_hit = F.expr("aggregate(hit_words, 0L, (total, span) -> total + span.end_word - span.first_word)")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


@query
def op4_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = line_dedup.deduplicated(docs)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_units", "n_dropped",
        F.length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@query
def op5_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = bpe.encoded(docs, public_tokenizers.path(VOCABULARY), with_ids=False)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op6_url_filters(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = url_filters.judged(pages)
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op7_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.neighbours(vectors, F.col("vec_id") % 20 == 0)


@query
def op8_ngram_join(spark, folder):
    found = ngram_join.joined(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
                        F.col("component").alias("component_id"))


@query
def op9_personal_data(spark, folder):
    found = personal_data.found(table(spark, folder, "documents").select("doc_id", "text"))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[number(kind) for kind in personal_data.BASE_KINDS],
        F.sha2(personal_data.written(F.col("base")), 256).alias("base_sha256"),
        personal_data.written(F.col("spans")).alias("spans"),
    )


@query
def op10_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.quality(docs, table(spark, folder, "labels"),
                            learnable=lambda known: toxicity.fold_of("id", 4) != 2)
    return found.select(*_score_columns("id", 4, 2, F.col("score"), quality.THRESHOLD))


@query
def op11_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    found = quality_rules.judged(docs)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("host_rejected_by", ",").alias("host_rejected_by"),
    )


@query
def op12_ranked_search(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = ranked_search.ranked(docs, table(spark, folder, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


#: Every so manieth checksum of an id is one whose row is changed after the manifest was made.
TAMPERED = 7


@query
def op13_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))

    def leaf(n_chars):
        return merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    now = F.when(tampered, leaf(F.col("n_chars") + 1)).otherwise(leaf(F.col("n_chars")))
    made = merkle.manifest(
        docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), leaf(F.col("n_chars")).alias("leaf"),
                    now.alias("leaf_now")), ["leaf_now"])
    found = made.withColumn("folded_root", merkle.folded(F.col("leaf_now"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
