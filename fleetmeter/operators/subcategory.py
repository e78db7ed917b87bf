"""Product subcategories from free-text names.

All text work runs on distinct names with their row counts, not on the rows. Terms,
their weights and the clusters' centres are tables: no vocabulary reaches the driver.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetmeter.fixed_values import SUBCATEGORY_CLUSTERS
from fleetmeter.functions.text import clean_name, first_words, word_count
from fleetmeter.operators.predicates import optional
from fleetmeter.operators.sparse_kmeans import sparse_kmeans
from fleetmeter.sources.staging import staged

NAME = "cleaned_product_name"


def product_names(rows):
    """Distinct product names, their rows, their first two cleaned words.

    A NULL name is left out. A name that cleans to nothing has no words.
    """
    cleaned = first_words(clean_name(F.col("product_name")))
    return (
        rows.where(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(F.count("*").alias("rows"))
        .withColumn(NAME, cleaned)
        .withColumn("words", word_count(F.col(NAME)))
    )


def one_word(names):
    return names.where(F.col("words") == 1)


def several_words(names):
    return names.where(F.col("words") > 1)


def _documents(names):
    """Distinct cleaned names with their rows and terms of two letters or more, written once.

    A name has two words at most, so how often it has a term is counted inside its row.
    """
    words = F.filter(F.split(F.lower(NAME), " "), lambda term: F.length(term) >= 2)
    counted = F.transform(F.array_distinct("words"), lambda term: F.struct(
        term.alias("term"), F.size(F.filter("words", lambda word: word == term)).alias("occurrences")))
    documents = names.groupBy(NAME).agg(F.sum("rows").alias("rows")).withColumn("words", words)
    return staged(documents.withColumn("terms", counted).drop("words"), "names")


def _weights(documents):
    """(name, rows, term, weight) of written documents; a name's weights have length 1."""
    terms = documents.select(NAME, "rows", F.explode("terms").alias("of")).select(NAME, "rows", "of.*")
    # Every row counts as one document.
    total = documents.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    rarity = terms.groupBy("term").agg(F.sum("rows").alias("term_rows")).select(
        "term", (F.log((1 + total) / (1 + F.col("term_rows"))) + 1).alias("rarity"))
    value = F.col("occurrences") * F.col("rarity")
    # A window holds two rows.
    length = F.sqrt(F.sum(value * value).over(Window.partitionBy(NAME)))
    return terms.join(rarity, "term").select(NAME, "rows", "term", (value / length).alias("weight"))


def term_weights(names):
    """Weight of each term in each cleaned name."""
    return _weights(_documents(names))


def _labels(weights, assigned):
    """Per cluster, its two heaviest terms of the mean member, later letters first."""
    heaviest = Window.partitionBy("cluster").orderBy(F.desc("total"), F.desc("term"))
    return (
        weights.join(assigned, NAME)
        .groupBy("cluster", "term")
        .agg(F.sum(F.col("rows") * F.col("weight")).alias("total"))
        .withColumn("place", F.row_number().over(heaviest))
        .where("place <= 2")
        .groupBy("cluster")
        .agg(F.array_join(F.sort_array(F.collect_list("term"), asc=False), " ").alias("label"))
    )


def subcategories(rows, clusters=SUBCATEGORY_CLUSTERS, seed=0):
    """Subcategory per product name.

    A one-word name is its own; longer names take the label of their cluster, or
    keep their words where these have no term; empty names have none.
    """
    names = staged(product_names(rows), "product-names")
    several = several_words(names)
    weights = staged(_weights(_documents(several)), "weights")
    assigned = sparse_kmeans(weights, clusters, seed)
    labels = _labels(weights, assigned)
    labelled = several.join(assigned, NAME, "left").join(labels, "cluster", "left").select(
        "product_name", F.coalesce("label", NAME).alias("product_subcategory")
    )
    single = one_word(names).select("product_name", F.col(NAME).alias("product_subcategory"))
    return single.unionByName(labelled).withColumn(
        "product_subcategory", F.upper("product_subcategory")
    )


def with_subcategory(rows, mapping):
    """Rows with their subcategory; rows whose name has none are dropped."""
    return rows.join(mapping, "product_name")


def subcategory_options(report, categories=(), codes=()):
    """Subcategories left under the chosen categories and codes, alphabetical."""
    chosen = optional({"asset_category": categories, "asset_code": codes})
    column = "product_subcategory"
    return report.where(chosen).select(column).distinct().orderBy(F.asc_nulls_last(column))
