"""Product subcategories."""

import random

import pytest
from pyspark.sql import functions as F

from fleetmeter.operators import sparse_kmeans, subcategory
from fleetmeter.sources.staging import staged
from fleetmeter.plans.service_status import status_report
from fleetmeter.sources.shaping import cost_rows
from fleetmeter.sources.star import star_fact
from tests.conftest import FOLDER


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "product_name string")


def test_names_split_by_words(spark):
    found = subcategory.product_names(names(spark, ["Oli 15W40", "Oli 15W40", "40W", None, "ban luar x"]))
    rows = {r["product_name"]: (r["cleaned_product_name"], r["words"], r["rows"]) for r in found.collect()}
    assert rows == {"Oli 15W40": ("Oli", 1, 2), "40W": ("", 0, 1), "ban luar x": ("ban luar", 2, 1)}
    assert subcategory.one_word(found).count() == 1
    assert subcategory.several_words(found).count() == 1


def test_term_weights_by_hand(spark):
    found = subcategory.several_words(subcategory.product_names(
        names(spark, ["oil filter", "oil filter", "air filter", "a filter"])))
    weights = {(r["cleaned_product_name"], r["term"]): r["weight"]
               for r in subcategory.term_weights(found).collect()}
    from math import log, sqrt
    oil, filt = log(5 / 3) + 1, log(5 / 5) + 1
    assert weights["oil filter", "oil"] == pytest.approx(oil / sqrt(oil ** 2 + filt ** 2))
    assert weights["a filter", "filter"] == pytest.approx(1.0)
    assert ("a filter", "a") not in weights


def test_subcategory_labels(spark):
    values = ["Pompa", "40W", "oil filter", "oil filter 2", "air filter", "ban luar", "a b"]
    mapping = subcategory.subcategories(names(spark, values), clusters=3)
    rows = {r["product_name"]: r["product_subcategory"] for r in mapping.collect()}
    assert "40W" not in rows and rows["Pompa"] == "POMPA"
    assert set(rows) == set(values) - {"40W"}
    assert rows["oil filter"] == rows["oil filter 2"]
    for label in rows.values():
        assert label and label == label.upper() and len(label.split()) <= 2


def test_report_by_subcategory(spark):
    fact = star_fact(spark, FOLDER)
    mapping = cost_rows(fact).select("product_name").distinct().where("product_name IS NOT NULL").select(
        "product_name", F.upper(F.split("product_name", " ")[1]).alias("product_subcategory"))
    costs = subcategory.with_subcategory(cost_rows(fact), mapping)
    report = status_report(fact, costs, ("product_subcategory",)).drop("product_subcategory")
    # The subcategory follows from the name here, so it splits no line. Services of
    # unnamed products are left out with their rows.
    plain = status_report(fact, cost_rows(fact).where("product_name IS NOT NULL"))
    assert report.exceptAll(plain).count() == 0 and plain.exceptAll(report).count() == 0


def plain_lloyd(points, centres, rounds):
    """points: name -> (rows, vector), centres: name -> vector, vectors as dicts; centre of each point."""
    def dot(a, b):
        return sum(v * b.get(t, 0.0) for t, v in a.items())

    before = None
    for _ in range(rounds + 1):
        lengths = {c: dot(v, v) for c, v in centres.items()}
        found = {p: min((round(lengths[c] - 2 * dot(v, centres[c]), 12), c) for c in centres)[1]
                 for p, (_, v) in points.items()}
        if found == before:
            break
        before, centres = found, {}
        for c in set(found.values()):
            own = [points[p] for p in found if found[p] == c]
            size = sum(rows for rows, _ in own)
            centres[c] = {t: sum(rows * v.get(t, 0.0) for rows, v in own) / size for t in {t for _, v in own for t in v}}
    return before


@pytest.mark.parametrize("seed, clusters, rounds", [(1, 5, 20), (2, 9, 20), (3, 3, 1)])
def test_clusters_equal_plain_lloyd(spark, seed, clusters, rounds):
    rng = random.Random(seed)
    words = ["oil", "air", "fuel", "filter", "pump", "hose", "belt", "seal", "cap", "rod", "x"]
    values = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(150)]
    named = subcategory.several_words(subcategory.product_names(names(spark, values)))
    weights = staged(subcategory.term_weights(named), "weights")
    _, points = sparse_kmeans.distinct_points(weights)
    start = sparse_kmeans.starting_centres(points, clusters, seed)
    as_vectors = lambda rows, key: {k: {r["term"]: r["weight"] for r in rows if r[key] == k} for k in {r[key] for r in rows}}
    rows = points.collect()
    vectors, sizes = as_vectors(rows, "point"), {r["point"]: r["rows"] for r in rows}
    begin = as_vectors(start.collect(), "cluster")
    assert len(begin) == clusters < len(vectors)
    expected = plain_lloyd({p: (sizes[p], v) for p, v in vectors.items()}, begin, rounds)
    found = sparse_kmeans.sparse_kmeans(weights, clusters, seed, rounds).collect()
    place = {r["cleaned_product_name"]: r["point"] for r in sparse_kmeans.distinct_points(weights)[0].collect()}
    assert {r["cleaned_product_name"]: r["cluster"] for r in found} == {n: expected[p] for n, p in place.items()}
    assert 1 < len({r["cluster"] for r in found}) <= clusters


def test_heavier_points_start_more_often(spark):
    points = spark.createDataFrame([(f"p{i}", 1 + 999 * (i % 10 == 0), "t", 1.0) for i in range(100)],
                                   "point string, rows bigint, term string, weight double")
    drawn = [r[0] for s in range(5) for r in sparse_kmeans.starting_centres(points, 10, s).select("cluster").collect()]
    assert sum(name[-1] == "0" for name in drawn) > 40 and len(set(drawn)) > 10


def test_terms_stay_off_the_driver(spark, monkeypatch):
    """What reaches the driver: whether points moved, never terms or centres."""
    from pyspark.sql import classic
    sent = []
    frame = classic.dataframe.DataFrame
    for name in ("collect", "toPandas", "toLocalIterator"):
        held = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, *a, held=held, **k: sent.append(rows := held(self, *a, **k)) or rows)
    mapping = subcategory.subcategories(names(spark, ["oil filter", "air filter", "fuel pump", "fuel hose"]), clusters=2)
    assert all(len(rows) <= 1 for rows in sent)
    assert mapping.count() == 4


def test_weights_read_their_input_once(spark):
    fact = star_fact(spark, FOLDER)
    named = subcategory.several_words(subcategory.product_names(cost_rows(fact)))
    plan = subcategory.term_weights(named)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("Exchange hashpartitioning") <= 4
