"""k-means over sparse points held as tables.

A point is a few rows (name, rows, term, weight); so is a centre. A point is at
|c|^2 - 2 p.c from a centre, up to its own length, so it only meets centres that share
one of its terms; of all the others the one of least length is nearest, one row for all
points. Neither the terms nor the centres pass through the driver: it sees how many
points moved.

Equal points are one, so centres never start on the same place.
"""

from pyspark.sql import functions as F

from fleetmeter.sources.staging import staged

ROUNDS = 20


def distinct_points(weights):
    """(name, point) and (point, rows, term, weight): names of equal terms and weights are one point."""
    terms = F.array_sort(F.collect_list(F.struct("term", "weight")))
    named = weights.groupBy("cleaned_product_name").agg(F.first("rows").alias("rows"), terms.alias("terms"))
    named = named.withColumn("point", F.concat_ws(" ", F.transform("terms", lambda t: t["term"]),
                                                  F.transform("terms", lambda t: F.round(t["weight"], 12).cast("string"))))
    named = staged(named, "kmeans-names")
    points = named.groupBy("point").agg(F.sum("rows").alias("rows"), F.first("terms").alias("terms"))
    return named.select("cleaned_product_name", "point"), staged(
        points.select("point", "rows", F.explode("terms").alias("of")).select("point", "rows", "of.*"), "kmeans-points")


def starting_centres(points, clusters, seed):
    """(cluster, term, weight): a weighted sample of the points without replacement."""
    # The k largest of log(u) / rows, with u even in (0, 1): heavier points come up more often.
    even = (F.xxhash64("point", F.lit(seed)).bitwiseAND((1 << 53) - 1) + 0.5) / float(1 << 53)
    drawn = points.select("point", "rows").distinct().orderBy(F.desc(F.log(even) / F.col("rows")), "point").limit(clusters)
    return points.join(drawn.select("point"), "point").select(F.col("point").alias("cluster"), "term", "weight")


def assign(points, centres):
    """(point, cluster): the nearest centre of each point, the first by name where several are as near."""
    lengths = centres.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("weight")).alias("length"))
    parts = centres.select("cluster", "term", F.col("weight").alias("at"))
    met = points.join(parts, "term").groupBy("point", "cluster").agg(F.sum(F.col("weight") * F.col("at")).alias("dot"))
    # Sums come in any order: distances are told apart to twelve digits.
    distance = F.round(F.col("length") - 2 * F.col("dot"), 12)
    met = met.join(lengths, "cluster").groupBy("point").agg(F.min(F.struct(distance.alias("distance"), "cluster")).alias("best"))
    shortest = lengths.agg(F.min(F.struct(F.round("length", 12).alias("distance"), "cluster"))).scalar()
    every = points.select("point").distinct().join(met, "point", "left")
    return every.select("point", F.least("best", shortest)["cluster"].alias("cluster"))


def mean_centres(points, assigned):
    """(cluster, term, weight): the mean of each cluster's points by their rows; a cluster without points is gone."""
    held = points.join(assigned, "point")
    sizes = held.select("cluster", "point", "rows").distinct().groupBy("cluster").agg(F.sum("rows").alias("size"))
    sums = held.groupBy("cluster", "term").agg(F.sum(F.col("rows") * F.col("weight")).alias("total"))
    return sums.join(sizes, "cluster").select("cluster", "term", (F.col("total") / F.col("size")).alias("weight"))


def sparse_kmeans(weights, clusters, seed=0, rounds=ROUNDS):
    """(name, cluster) of each name in `weights` (cleaned_product_name, rows, term, weight), a written table."""
    names, points = distinct_points(weights)
    centres = staged(starting_centres(points, clusters, seed), "kmeans-centres")
    assigned = staged(assign(points, centres), "kmeans-assigned")
    for _ in range(rounds):
        centres = staged(mean_centres(points, assigned), "kmeans-centres")
        after = staged(assign(points, centres), "kmeans-assigned")
        moved = not after.join(assigned.withColumnRenamed("cluster", "before"), "point").where(
            "cluster <> before").isEmpty()
        assigned = after
        if not moved:
            break
    return staged(names.join(assigned, "point").select("cleaned_product_name", "cluster"), "clusters")
