"""Quality rules by host: counts against plain ones, rates against the SQL, hosts that fail."""

import random
import re

import duckdb
import numpy as np
import pytest

from checks.compare import difference
from fleetmeter.llm import batches, quality_rules
from fleetmeter.llm.oracle import ORACLE
from fleetmeter.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    own = WORD.findall(text)
    windows = [tuple(own[i:i + 5]) for i in range(len(own) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines),
            len(lines) - len(set(lines)), len(inside))


def random_text(rng):
    words = ["a", "bé", "#", "c|d", "ö x", "f", " ", "\n", "\n", "\r\n", "\t"]
    return " ".join(rng.choice(words[:6 + rng.randrange(6)]) for _ in range(rng.randrange(60)))


def test_counts_equal_plain_ones():
    rng = random.Random(1)
    texts = ["", "x", "a b c d e a b c d e", "\n\n a\n a\n", "a\na\n a"] + [random_text(rng) for _ in range(200)]
    data = [t.encode() for t in texts]
    starts = np.r_[0, np.cumsum([len(d) for d in data])]
    columns = quality_rules.counted_texts(b"".join(data), starts)
    assert list(zip(*[c.tolist() for c in columns])) == [plain_counts(t) for t in texts]


@pytest.mark.parametrize("chunk", [1, 7, 50])
def test_long_texts_in_slices(monkeypatch, chunk):
    rng = random.Random(2)
    monkeypatch.setattr(batches, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(quality_rules, "CHUNK_BYTES", chunk)
    for _ in range(40):
        text = random_text(rng) + "w" * rng.choice([0, 90]) + "\n" + " " * rng.choice([0, 90])
        data = text.encode() * 2
        if len(data):
            columns = quality_rules.counted_texts(data, np.array([0, len(data)]))
            assert tuple(int(c[0]) for c in columns) == plain_counts(text * 2)


def written(spark, tmp_path, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con


def hosts(rng):
    """A bad host, a good one, many small ones of which some fail throughout, one without a name."""
    good = lambda: " ".join(rng.choices("the of and to in on as at by or if up we us it is".split(), k=30))
    bad = lambda: " ".join(["buy | now"] * 12 + [str(rng.random())])
    rows = [("big", good()) for _ in range(300)] + [("bad", bad() if rng.random() < 0.9 else good()) for _ in range(80)]
    for n in range(25):
        rows += [(f"small{n}", bad() if n % 9 == 0 else good()) for _ in range(1 + n % 3)]
    rows += [(None, good()), (None, None), ("big", ""), ("bad", "x\n" * 40)]
    return [(i // 2 * 2 if i % 50 == 1 else i, text, host) for i, (host, text) in enumerate(rows)]


def test_hosts_and_sql(spark, tmp_path):
    rows = hosts(random.Random(3))
    con = written(spark, tmp_path, rows)
    found = QUERIES["op11_quality_rules"](spark, str(tmp_path))
    assert difference(found, con, ORACLE["op11_quality_rules"]) is None
    by_host = {}
    for row in quality_rules.judged(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        by_host.setdefault(row["row"]["source"], []).append(row)
    assert all("repeated_words" in r["host_rejected_by"] and not r["kept"] for r in by_host["bad"])
    assert any(not r["base_failed"] for r in by_host["bad"])
    assert all(r["kept"] for r in by_host["big"] if r["n_words"] > 9)
    assert sum(r["kept"] for r in by_host["small1"]) == len(by_host["small1"])


def test_rates_are_shrunk(spark):
    rows = [("big", 1000, 10), ("one", 1, 1), ("ten", 10, 10)] + [(f"s{n}", 20, n % 2) for n in range(20)]
    totals = spark.createDataFrame([(h, "r", n, f) for h, n, f in rows], "host string, rule string, documents bigint, failures bigint")
    rates = {r["host"]: r["rate"] for r in quality_rules.host_verdicts(totals).collect()}
    assert 0.009 < rates["big"] < 0.012 and rates["one"] < rates["ten"] < 1
    n, f = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    mean, k = f.sum() / n.sum(), len(n)
    share = ((n * (f / n - mean) ** 2).sum() - mean * (1 - mean) * (k - 1)) / (
        mean * (1 - mean) * (n.sum() - (n * n).sum() / n.sum() - (k - 1)))
    assert 0 < share < 1
    weight = (1 - share) / share
    assert rates["one"] == pytest.approx((weight * mean + 1) / (weight + 1))


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, source string, kept boolean, host string, n_words string, row int"
    empty = quality_rules.judged(spark.createDataFrame([], schema))
    assert empty.count() == 0
    rows = [(None, None, None, True, "h", "7", 1), (1, "", "s", None, None, None, None), (1, "", "s", None, None, None, None)]
    found = quality_rules.judged(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 3 and not any(r["kept"] for r in found)
    assert sorted(r["row"]["n_words"] or "" for r in found) == ["", "", "7"]
