"""Merkle manifest: against a plain tree, the SQL, and blocks of every size."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from fleetmeter.llm import merkle
from fleetmeter.llm.oracle import ORACLE
from fleetmeter.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, path string, root int, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of each leaf, fold of each leaf from another digest)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i:i + 2]) for i in range(0, len(below), 2)])

    def siblings(i):
        return [level[i >> n ^ 1] if i >> n ^ 1 < len(level) else None for n, level in enumerate(levels[:-1])]

    return levels[-1][0], siblings


def fold(digest, i, siblings):
    for n, other in enumerate(siblings):
        digest = h(digest) if other is None else h(other, digest) if i >> n & 1 else h(digest, other)
    return digest


@pytest.mark.parametrize("count", [*range(1, 18), 31, 32, 33])
def test_open_tree(count):
    leaves = [h(str(i)) for i in range(count)]
    tree = merkle.OpenTree()
    for leaf in leaves:
        tree.append(bytes.fromhex(leaf))
    root, siblings = plain_tree(leaves)
    assert tree.close().hex() == root
    for i, path in enumerate(tree.paths):
        assert [d and d.hex() for _, d in path] == siblings(i)


def rows_of(rng, counts):
    rows = []
    for lang, count in counts.items():
        ids = [rng.randrange(10 ** 6) for _ in range(count)]
        rows += [(i, rng.choice(["é" * rng.randrange(9), "", None]), lang, rng.choice(["s", None]),
                  rng.choice([None, 3]), "p", 1, "d") for i in ids]
    rows += rows[:3] + [(None, "no id", lang, "s", 1, "p", 1, "d"), (None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    def leaf(r, more=0):
        n = None if r[4] is None else r[4] + more
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])])

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    found, subroots = [], []
    for lang in order:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *plain_tree([leaf(r) for r in own]))
        subroots.append(trees[lang][1])
    root, above = plain_tree(subroots)
    for place, lang in enumerate(order):
        own, subroot, siblings = trees[lang]
        for i, r in enumerate(own):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            start, end = siblings(i), above(place)
            got = fold(fold(leaf(r, int(tampered)), i, start), place, end)
            found.append((r[0], leaf(r), subroot, root, h(*[s for s in start + end if s]), got, got == root))
    return found


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con


def test_query_against_plain_trees_and_sql(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = rows_of(rng, {"en": 150, "de": 33, "fr": 16, "é": 1, "zz": 2, None: 5})
    con = table(spark, tmp_path, rows)
    query = QUERIES["op13_merkle_manifest"]
    key = lambda r: tuple((v is not None, v) for v in r)
    wanted = sorted(expected(rows), key=key)
    assert {r[6] for r in wanted} == {True, False}
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=key) == wanted
    assert difference(query(spark, str(tmp_path)), con, ORACLE["op13_merkle_manifest"]) is None
    for block in (2, 4, 16):
        made = merkle.manifest(spark.read.parquet(f"{tmp_path}/documents.parquet").select(
            F.col("lang").alias("tree"), F.col("doc_id").alias("id"),
            merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf")), block_leaves=block)
        found = made.select("id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256),
                            merkle.folded(F.col("leaf"), F.col("path")))
        assert sorted((tuple(r)[:5] for r in found.collect()), key=key) == sorted((r[:5] for r in wanted), key=key)
        assert found.where("root <> `" + found.columns[-1] + "`").isEmpty()


def test_one_row_and_no_row(spark, tmp_path):
    con = table(spark, tmp_path / "one", [(7, "x" * 3_000_000, "en", "s", 1, "p", 1, "d")])
    query = QUERIES["op13_merkle_manifest"]
    assert difference(query(spark, str(tmp_path / "one")), con, ORACLE["op13_merkle_manifest"]) is None
    table(spark, tmp_path / "none", [])
    assert query(spark, str(tmp_path / "none")).count() == 0


def test_numbers_are_dense(spark):
    from fleetmeter.operators.numbering import in_order, numbered
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    grouped = frame.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    found = numbered(in_order(grouped, [F.asc("g"), F.asc("v")], "numbers"), ["g"], total="total").collect()
    for group in (None, 1, 2):
        own = sorted((r["v"], r["number"], r["total"]) for r in found if r["g"] == group)
        assert [n for _, n, _ in own] == list(range(len(own))) and {t for *_, t in own} == {len(own)}
