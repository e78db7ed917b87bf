"""Operators over whole corpora against plain computations."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmeter.llm import batches, neighbours, ngram_join, quality, toxicity
from fleetmeter.llm.queries import QUERIES
from tests.conftest import FOLDER

SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = {c: c + 32 for c in range(65, 91)}


# --- n-gram join -----------------------------------------------------------------


def shingles(text):
    own = SOLID.findall((text or "").translate(LOWERED))
    if len(own) >= 5:
        return frozenset(tuple(own[i:i + 5]) for i in range(len(own) - 4))
    return frozenset([tuple(own)]) if own else frozenset()


def plain_components(rows):
    """Smallest id reached by links, rows with one id taken as one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, (i, one) in enumerate(sets):
        for j, two in sets[:a]:
            if one and two and 100 * len(one & two) >= 80 * len(one | two):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return {i: find(i) for i in least}


def check_join(documents, rows):
    found = ngram_join.joined(documents(rows)).collect()
    wanted = plain_components(rows)
    assert len(found) == len(rows)
    sizes = sorted((str(r["id"]), r["size"]) for r in found)
    assert sizes == sorted((str(i), len(shingles(t))) for i, t in rows)
    for row in found:
        assert row["component"] == (None if row["id"] is None else wanted[row["id"]])


def _edited(draw, base, edits):
    own = list(base)
    for _ in range(edits):
        own[draw.randrange(len(own))] = f"w{draw.randrange(10 ** 6)}"
    return own


def test_join_of_near_copies(documents):
    draw = random.Random(7)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "a b c d e"), (8, "a b c d E"),
            (9, "dup dup dup dup dup dup"), (9, "dup dup dup dup dup dup"), (9, "another text of the same id here"),
            (10, "another text of the same id here"), (None, "a b"), (None, None)]
    number = 100
    for size in (6, 9, 12, 20, 45, 150, 700):
        for _ in range(3):
            base = [f"v{draw.randrange(10 ** 6)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 4, 6):
                rows.append((number, " ".join(_edited(draw, base, edits * size // 80 if size > 80 else min(edits, 1)))))
                number += 1
    check_join(documents, rows)


def test_join_with_large_groups_and_shared_passages(documents, monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 1)
    passage = [f"p{i}" for i in range(25)]
    base = [f"b{i}" for i in range(90)]
    rows = [(i, " ".join(_edited(draw, base, draw.choice([1, 2, 3, 5])))) for i in range(60)]
    rows += [(100 + i, " ".join([f"u{i}x{k}" for k in range(draw.choice([3, 8, 12, 30]))] + passage)) for i in range(60)]
    rows += [(200 + i, " ".join(base)) for i in range(20)]
    check_join(documents, rows)


@pytest.mark.parametrize("size", [1, 5, 8, 13, 40, 333])
def test_similar_sets_share_a_signature(size):
    """A set and one that differs as much as it may share more parts than the spare ones."""
    draw = np.random.default_rng(size)
    for _ in range(20):
        own = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
        out = draw.integers(0, len(own) // 10 + 1)
        other = np.unique(np.r_[own[out:], draw.integers(0, 1 << 63, out, dtype=np.uint64)])
        shared = len(np.intersect1d(own, other))
        if 100 * shared >= 80 * (len(own) + len(other) - shared):
            assert len(np.intersect1d(ngram_join.signatures(own), ngram_join.signatures(other)))


def test_join_of_nothing(documents):
    assert ngram_join.joined(documents([])).count() == 0
    check_join(documents, [(1, "alone"), (2, None)])


@pytest.mark.parametrize("text", ["hello world", "one two three"])
def test_join_of_a_row_of_few_words(documents, text):
    check_join(documents, [(1, text)])


@pytest.mark.parametrize("text", ["hello world", "one two three"])
def test_join_of_few_words_after_a_long_text(documents, text):
    long = " ".join(f"w{i}" for i in range(200_000))
    assert len(long) > batches.CHUNK_BYTES
    check_join(lambda rows: documents(rows).coalesce(1), [(1, text), (2, long), (3, text)])


# --- neighbours ------------------------------------------------------------------


def plain_neighbours(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            usable[i] = np.array(v)
    out = {}
    for i, v in usable.items():
        if i % 20 == 0:
            ranked = sorted(((-float(v @ w), j) for j, w in usable.items() if j != i))
            out[i] = [j for _, j in ranked[:k]]
    return out


def test_neighbours_small(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4),
             (305, [float("inf")] * 4), (None, [1.0] * 4), (3, rows[3][1]), (306, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.neighbours(vectors, F.col("vec_id") % 20 == 0, k=5, recall=1.0).toPandas()
    wanted = plain_neighbours([r for r in rows if r[0] != 306], 5)
    hits = every = 0
    for query, ids in wanted.items():
        own = found[found.query_id == query].sort_values("rank")
        assert list(own["rank"]) == list(range(1, len(ids) + 1))
        hits += len(set(own.vec_id) & set(ids))
        every += len(ids)
    assert set(found.query_id) == set(wanted) and hits / every >= 0.9
    # Queries among the copies take the smaller ids first.
    assert list(found[found.query_id == 200].sort_values("rank").vec_id) == [201, 202, 203, 204, 205]


@pytest.mark.parametrize("seed", range(3))
def test_best_places(seed):
    score = np.random.default_rng(seed).integers(0, 5, (7, 9)).astype(float)
    for count in (1, 4, 9, 20):
        row, at = neighbours.best_places(score, count)
        plain = [(i, j) for i in range(7) for j in sorted(range(9), key=lambda j: (-score[i, j], j))[:count]]
        assert list(zip(row.tolist(), at.tolist())) == plain


def test_neighbours_few_and_none(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.0, 1.0], 1)], schema)
    rows = neighbours.neighbours(few, F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert neighbours.neighbours(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.neighbours(few.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("folder", [FOLDER])
def test_neighbours_recall(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], None if r[1] is None else [float(x) for x in r[1]]) for r in vectors.collect()]
    wanted = plain_neighbours(rows, 20)
    found = QUERIES["op7_neighbours"](spark, folder).toPandas()
    hits = sum(len(set(found[found.query_id == q].vec_id) & set(ids)) for q, ids in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.9


# --- classifiers -----------------------------------------------------------------


def _labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_toxicity_learns_words(spark, documents):
    draw = random.Random(9)
    calm = ["river", "stone", "morning", "window", "garden", "letter", "paper", "winter"]
    rows, labels = [], []
    for i in range(240):
        own = [draw.choice(calm) for _ in range(draw.randint(5, 400))]
        toxic = i % 4 == 0
        if toxic:
            own.insert(draw.randrange(len(own)), draw.choice(["dreadful scum", "you moron"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "you moron here"), (5, rows[5][1])]
    docs = documents(rows)
    known = _labels(spark, labels[:160] + [(None, 1), (901, None)], "toxic")
    model = toxicity.train(docs, known)
    scores = toxicity.scored(docs, model).select("row.doc_id", "row.text", "score").collect()
    assert len(scores) == len(rows)
    for row in scores:
        assert 0 <= row["score"] <= 1
        if row["doc_id"] is not None and 160 <= row["doc_id"] < 240:
            assert (row["score"] >= toxicity.THRESHOLD) == (row["doc_id"] % 4 == 0)
    assert [r["score"] for r in scores if r["doc_id"] is None][0] > 0.7
    assert len({r["score"] for r in scores if r["doc_id"] in (900, 901)}) == 1


def test_classifiers_without_labels(spark, documents):
    docs = documents([(1, "a text"), (2, None)])
    model = toxicity.train(docs, _labels(spark, [(1, 1)], "toxic"))
    assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {0.5}
    found = quality.quality(docs, _labels(spark, [(1, 1)], "quality")).collect()
    assert {r["score"] for r in found} == {0.5} and len(found) == 2
    assert quality.quality(documents([]), _labels(spark, [], "quality")).count() == 0


def test_isotonic_is_the_least_squares_order():
    draw = np.random.default_rng(1)
    counts = draw.integers(0, 4, 60)
    sums = np.array([draw.integers(0, c + 1) for c in counts], float)
    steps = quality.isotonic(sums, counts.astype(float))
    assert len(steps) == 60 and (np.diff(steps) >= 0).all()
    # Pooling keeps the total.
    assert abs((steps * counts).sum() - sums.sum()) < 1e-9


@pytest.mark.parametrize("name,label,parts,remainder", [
    ("op2_toxicity", "toxic", 3, 1), ("op10_quality", "quality", 4, 2)])
def test_held_out_accuracy(spark, name, label, parts, remainder):
    folder = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).alias("known"))
    found = QUERIES[name](spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(known, "doc_id").where("held_out").toPandas()
    assert ((rows.predicted == 1) == (rows.known == 1)).mean() >= 0.85
    ranks = rows.score.rank()
    ones, zeros = (rows.known == 1).sum(), (rows.known == 0).sum()
    assert (ranks[rows.known == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) > 0.93
