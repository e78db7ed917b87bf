"""Approximate nearest neighbours over learned partitions.

On a bounded sample of distinct vectors the graph of nearest neighbours is cut into
balanced partitions that keep neighbours together. A small network learns to say
which partition holds a vector's neighbours. Every vector is stored in the partition
it is most likely to belong to; a query looks into its most probable partitions, as
many as the sample shows to be needed for the recall asked for, and what it finds
there is ranked by the exact inner product.

Copies of a vector are one entry with its least ids, as many as a result can need. A
partition is searched in blocks of bounded size, each against blocks of queries, so
that one task holds neither a large partition nor all queries.

Defined cases: vectors that are NULL, empty, zero, or hold a NULL or a component that
is not finite take no part, nor do those of another length than the most common one
(the shorter at a tie), nor rows without an id; of different vectors under one id the
one of least hash counts; ties go to the smaller id; fewer candidates than asked for
give shorter lists; no vectors give no rows.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetmeter.sources.staging import staged

#: Distinct vectors the index is fitted on, chosen by a hash of their ids: the bound.
SAMPLE = 6000
GRAPH_NEIGHBOURS = 10
MOST_PARTITIONS = 128
SLACK = 1.1
HIDDEN = 96
#: Share of the true neighbours that the sample must find, which sets the probes.
RECALL = 0.97
#: Vectors, and queries, of one search step.
BLOCK = 4096
SEED = 11


def partition_count(vectors):
    return int(np.clip(np.sqrt(max(vectors, 1)) / 4, 4, MOST_PARTITIONS))


def nearest(queries, vectors, count, own=None):
    """Positions of the largest inner products, best first, in blocks."""
    found = []
    for begin in range(0, len(queries), 512):
        score = queries[begin:begin + 512] @ vectors.T
        if own is not None:
            rows = np.arange(len(score))
            score[rows, own[begin:begin + 512]] = -np.inf
        count = min(count, score.shape[1])
        top = np.argpartition(-score, count - 1, axis=1)[:, :count]
        order = np.argsort(-np.take_along_axis(score, top, 1), axis=1)
        found.append(np.take_along_axis(top, order, 1))
    return np.concatenate(found) if found else np.zeros((0, count), int)


def balanced_partition(vectors, graph, parts, rounds=12):
    """A partition of each vector, of nearly equal sizes, that cuts few graph edges.

    Starts from centres filled up to their capacity; then vectors move, those with
    most to gain first, to the partition most of their graph neighbours are in,
    while it has room.
    """
    draw = np.random.default_rng(SEED)
    count = len(vectors)
    room = int(np.ceil(count / parts * SLACK))
    centres = vectors[draw.choice(count, parts, replace=False)]
    label = np.zeros(count, int)
    for _ in range(8):
        score = vectors @ centres.T
        label = _filled(score, room)
        centres = np.stack([
            vectors[label == p].mean(axis=0) if (label == p).any() else centres[p] for p in range(parts)
        ])
    edges = np.concatenate([
        np.stack([np.repeat(np.arange(count), graph.shape[1]), graph.ravel()], 1),
        np.stack([graph.ravel(), np.repeat(np.arange(count), graph.shape[1])], 1),
    ])
    for _ in range(rounds):
        votes = np.bincount(edges[:, 0] * parts + label[edges[:, 1]], minlength=count * parts)
        votes = votes.reshape(count, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(count), best] - votes[np.arange(count), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[best[node]] < room:
                sizes[label[node]] -= 1
                sizes[best[node]] += 1
                label[node] = best[node]
                moved += 1
        if moved < count / 200:
            break
    return label


def _filled(score, room):
    """Each row's best column that still has room, rows with the clearest choice first."""
    order = np.argsort(-score, axis=1)
    ranked = np.sort(score, axis=1)
    clear = ranked[:, -1] - ranked[:, -2] if score.shape[1] > 1 else ranked[:, -1]
    sizes, label = np.zeros(score.shape[1], int), np.zeros(len(score), int)
    for row in np.argsort(-clear, kind="stable"):
        for column in order[row]:
            if sizes[column] < room:
                sizes[column] += 1
                label[row] = column
                break
    return label


class Router:
    """A network with one hidden layer: vector -> probability of each partition."""

    def __init__(self, inputs, parts):
        draw = np.random.default_rng(SEED)
        self.weights = [
            draw.normal(size=(inputs, HIDDEN)) * np.sqrt(2 / inputs), np.zeros(HIDDEN),
            draw.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts),
        ]
        self.probes = parts

    @staticmethod
    def scaled(vectors):
        sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(sizes > 0, sizes, 1) * np.sqrt(vectors.shape[1])

    def raw(self, vectors):
        a, b, c, d = self.weights
        return np.maximum(self.scaled(vectors) @ a + b, 0) @ c + d

    def train(self, vectors, target, epochs=40, batch=128, rate=3e-3):
        """Adam on the cross entropy with the partitions of each vector's neighbours."""
        draw = np.random.default_rng(SEED)
        inputs = self.scaled(vectors)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            order = draw.permutation(len(inputs))
            for begin in range(0, len(order), batch):
                rows = order[begin:begin + batch]
                a, b, c, d = self.weights
                hidden = np.maximum(inputs[rows] @ a + b, 0)
                out = hidden @ c + d
                out = np.exp(out - out.max(axis=1, keepdims=True))
                error = (out / out.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (error @ c.T) * (hidden > 0)
                slopes = [inputs[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
                step += 1
                for w, slope, (first, second) in zip(self.weights, slopes, moments):
                    first += 0.1 * (slope - first)
                    second += 0.001 * (slope * slope - second)
                    w -= pace * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)

    def home(self, vectors):
        return self.raw(vectors).argmax(axis=1)

    def ranked(self, vectors):
        return np.argsort(-self.raw(vectors), axis=1, kind="stable")


def fit(vectors, parts, neighbours, recall=RECALL):
    """A router for `parts` partitions from sample vectors, and how many to look into."""
    parts = max(1, min(parts, len(vectors) // 8))
    router = Router(vectors.shape[1], parts)
    if parts == 1:
        router.probes = 1
        return router
    own = np.arange(len(vectors))
    graph = nearest(vectors, vectors, GRAPH_NEIGHBOURS, own)
    label = balanced_partition(vectors, graph, parts)
    # A fifth of the sample is kept from training and tells how many probes are needed.
    held = np.arange(len(vectors)) % 5 == 0
    target = np.zeros((len(vectors), parts))
    np.add.at(target, (np.repeat(own, graph.shape[1]), label[graph].ravel()), 1.0)
    target[own, label] += GRAPH_NEIGHBOURS / 2
    target /= target.sum(axis=1, keepdims=True)
    router.train(vectors[~held], target[~held])
    home = router.home(vectors)
    ranked = router.ranked(vectors[held])
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(ranked), 0), 1)
    truth = nearest(vectors[held], vectors, neighbours, own[held])
    needed = np.take_along_axis(place, home[truth], 1)
    reached = (needed[:, :, None] <= np.arange(parts)).mean(axis=(0, 1))
    router.probes = int(np.searchsorted(reached, recall) + 1)
    router.probes = min(router.probes, parts)
    return router


def best_places(score, count):
    """(row, column) of the `count` largest of each row, largest first, ties to the smaller column."""
    count = min(count, score.shape[1])
    # All at the last place's score, so that ties are settled by column.
    least = np.partition(score, score.shape[1] - count, axis=1)[:, score.shape[1] - count]
    row, at = np.nonzero(score >= least[:, None])
    order = np.lexsort((at, -score[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < count], at[place < count]


def usable(vectors, id_column, vector_column):
    """(vec_id, embedding) of the vectors that take part, one for each id."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"),
                          F.col(vector_column).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & nonzero)
    rows = rows.groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    return rows


def distinct_vectors(rows, keep):
    """(entry, embedding, ids): copies as one entry, by their least id, with `keep` ids at most."""
    key = F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b")
    numbered = rows.select("*", *key).withColumn(
        "place", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    ).where(F.col("place") <= keep)
    grouped = numbered.groupBy("a", "b").agg(
        F.min("vec_id").alias("entry"), F.array_sort(F.collect_list("vec_id")).alias("ids"),
        F.first("embedding").alias("embedding"))
    return grouped.select("entry", "embedding", "ids")


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _placed(rows, router, probes):
    """Adds `parts`, the most probable partitions of each vector."""

    def place(batches):
        for batch in batches:
            ranked = router.value.ranked(_matrix(batch.column(1)))[:, :probes]
            parts = pa.FixedSizeListArray.from_arrays(pa.array(ranked.ravel().astype(np.int32)), ranked.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, parts.cast(pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    columns = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(place, f"{columns}, parts array<int>")


def neighbours(vectors, asked, k=20, id_column="vec_id", vector_column="embedding",
               sample=SAMPLE, recall=RECALL):
    """(query_id, rank, vec_id, score): the k nearest found of the ids that `asked` accepts.

    `asked` is a condition on the column vec_id. Every vector is indexed; only the
    sample and one number for each partition reach the driver.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    rows = staged(rows, "neighbours-usable")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return empty
    rows = rows.where(F.size("embedding") == width["width"])
    entries = staged(distinct_vectors(rows, k + 1), "neighbours-entries")
    total = entries.count()
    chosen = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("embedding").collect()
    fitted = fit(np.array([r["embedding"] for r in chosen]), partition_count(total), k, recall)
    router = spark.sparkContext.broadcast(fitted)
    indexed = _placed(entries, router, 1).withColumn("part", F.col("parts")[0]).drop("parts")
    indexed = staged(indexed, "neighbours-index")
    sizes = indexed.groupBy("part").agg(F.count("*").alias("n")).collect()
    blocks = {r["part"]: -(-r["n"] // BLOCK) for r in sizes}
    block_of = F.coalesce(*[F.when(F.col("part") == p, b) for p, b in sorted(blocks.items())])
    stored = indexed.withColumn("block", F.pmod(F.xxhash64("entry"), block_of).cast("int"))
    queries = _placed(rows.where(asked), router, fitted.probes)
    looks = queries.select("vec_id", "embedding", F.explode("parts").alias("part"))
    looks = looks.where(F.col("part").isin([p for p in blocks]))
    asked_count = rows.where(asked).count()
    groups = max(1, -(-asked_count // (4 * BLOCK)))
    looks = looks.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "part",
        F.explode(F.sequence(F.lit(0), block_of - 1)).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("crowd"))
    stored = stored.select("entry", "embedding", "ids", "part", "block",
                           F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("crowd"))

    def search(asking, held):
        if not len(asking) or not len(held):
            return pd.DataFrame({"query_id": [], "score": [], "ids": []})
        held = held.sort_values("entry")
        vectors_here = np.stack(held["embedding"].to_numpy())
        ids = held["ids"].to_numpy()
        names, out = asking["query_id"].to_numpy(), []
        for begin in range(0, len(asking), 256):
            score = np.stack(asking["query"].iloc[begin:begin + 256].to_numpy()) @ vectors_here.T
            row, at = best_places(score, k + 1)
            out.append(pd.DataFrame({"query_id": names[begin + row], "score": score[row, at], "ids": ids[at]}))
        return pd.concat(out)

    found = looks.groupBy("part", "block", "crowd").cogroup(
        stored.groupBy("part", "block", "crowd")
    ).applyInPandas(search, "query_id bigint, score double, ids array<bigint>")
    rows = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
