"""Ranked search: shared sums against plain ones, the query against the SQL."""

import random

import duckdb
import numpy as np
import pytest

from checks.compare import difference
from fleetmeter.llm import ranked_search
from fleetmeter.llm.oracle import ORACLE
from fleetmeter.llm.queries import QUERIES


@pytest.mark.parametrize("seed", range(4))
def test_shared_sums(seed):
    rng = random.Random(seed)
    common = [{t: 1 for t in rng.sample(range(30), 6)} for _ in range(5)]
    items = [{**rng.choice(common), **{rng.randrange(40): 1 + rng.randrange(3) for _ in range(rng.randrange(5))}}
             for _ in range(40)] + [{}]
    plan = ranked_search.SharedSums(items)
    products = np.array([[rng.randrange(100) for _ in range(9)] for _ in range(40)], np.int64)
    plain = [[sum(times * int(products[t, d]) for t, times in item.items()) for d in range(9)] for item in items]
    assert plan.sums(products).tolist() == plain
    # Shared sets are made once: fewer additions than terms.
    additions = plan.symbols - len(plan.leaf_terms) + sum(map(len, plan.items))
    assert plan.levels and additions < sum(map(len, items)) * 0.8


@pytest.mark.parametrize("seed", range(3))
def test_best_keeps_ties_in_order(seed):
    rng = random.Random(seed)
    best, rows = ranked_search.Best(1, 4), []
    for _ in range(6):
        ids = np.array([rng.randrange(50) for _ in range(7)])
        unnamed = np.array([rng.random() < 0.2 for _ in range(7)])
        scores = np.array([[rng.randrange(4) for _ in range(7)]])
        best.add(scores, ids, unnamed)
        rows += [(-s, bool(u), 0 if u else int(i)) for s, u, i in zip(scores[0], unnamed, ids) if s]
    found = best.rows().to_pylist()
    wanted = sorted(rows)[:4]
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in found] == wanted


def tables(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, rank int, score double").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


def some_tables(rng):
    words = ["The", "the", "of", "a1", "é", "x-y", "z", "q", "über", "rare", *[f"w{i}" for i in range(20)]]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(30))) for i in range(120)]
    docs += [(i + 500, docs[0][1]) for i in range(30)] + docs[:5] + [(None, docs[0][1]), (None, None), (3, ""), (4, "-- --")]
    items = [(i, text(rng.randrange(12))) for i in range(30)] + [(5, text(5)), (None, text(5)), (40, None), (41, "nowhere")]
    return [(i, t, "c", 1, 0.5) for i, t in docs], items


def test_query_and_sql(spark, tmp_path):
    docs, items = some_tables(random.Random(5))
    con = tables(spark, tmp_path, docs, items)
    sql = ORACLE["op12_ranked_search"]
    assert difference(QUERIES["op12_ranked_search"](spark, str(tmp_path)), con, sql) is None
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    blocks = ranked_search.ranked(read("documents").repartition(7), read("benchmark"), block_items=9)
    assert difference(blocks.select("item_id", "rank", "doc_id", "score"), con, sql) is None


def test_odd_tables(spark, tmp_path):
    con = tables(spark, tmp_path / "a", [], [(1, "a")])
    assert QUERIES["op12_ranked_search"](spark, str(tmp_path / "a")).count() == 0
    con = tables(spark, tmp_path / "b", [(1, "a", "c", 1, 0.5)], [])
    assert QUERIES["op12_ranked_search"](spark, str(tmp_path / "b")).count() == 0
    long = "word " * 500_000 + "x" * 1_500_000 + " last"
    con = tables(spark, tmp_path / "c", [(1, long, "c", 1, 0.5), (2, "word", "c", 1, 0.5)], [(1, "word last"), (2, "x" * 1_500_000)])
    assert difference(QUERIES["op12_ranked_search"](spark, str(tmp_path / "c")), con, ORACLE["op12_ranked_search"]) is None
