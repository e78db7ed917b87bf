"""The tree of line templates: what its leaves merge, and the query against the SQL on such rows."""

import random

import duckdb
import pytest

from checks.compare import difference
from fleetmeter.llm import line_dedup
from fleetmeter.llm.oracle import ORACLE
from fleetmeter.llm.queries import QUERIES


def against_sql(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return difference(QUERIES["op4_line_dedup"](spark, str(folder)), con, ORACLE["op4_line_dedup"])


def kept(documents, texts):
    return {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup.deduplicated(documents(texts)).collect()}


def test_a_leaf_merges_one_field(documents):
    base = "the job called {0} has ended on the host called {1} without an error today"
    texts = [(1, base.format("alpha", "north")), (2, base.format("beta", "north")), (3, base.format("gamma", "south")),
             # Two fields away from the first, one from the third.
             (4, base.format("alpha", "south")),
             # Other leading tokens, another number of tokens: other leaves.
             (5, base.format("beta", "north").replace("the job", "a job")), (6, base.format("beta", "north") + " again")]
    found = kept(documents, texts)
    assert found == {1: texts[0][1], 2: "", 3: texts[2][1], 4: "", 5: texts[4][1], 6: texts[5][1]}


def test_prose_of_one_leaf_stays(documents):
    texts = [(1, "it was a cold night and the wind blew over the hills"), (2, "it was a warm night and the rain fell over the roofs"),
             (3, "it was a long day when the train stood in the station")]
    assert kept(documents, texts) == dict(texts)
    # Longer units are not merged, whatever they share.
    long = " ".join(f"word{chr(97 + i)}" for i in range(26))
    assert kept(documents, [(1, long), (2, long.replace("wordp", "other"))]) == {1: long, 2: long.replace("wordp", "other")}


@pytest.mark.parametrize("seed", [1, 2])
def test_query_and_sql_on_templates_and_numbers(spark, tmp_path, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["oil", "air", "the", "a", "of", "é", "end.", "no!", "why?", "x"])
    number = lambda: rng.choice(["1", "22", "3.5", "v4", "2024-01-02", "7."])
    frames = [" ".join(word() for _ in range(rng.choice([5, 8, 12, 20]))) for _ in range(12)]

    def line():
        kind = rng.randrange(5)
        if kind == 0:
            return " ".join(number() for _ in range(rng.randrange(1, 6)))
        if kind == 1:
            return " ".join(rng.choice([word, number])() for _ in range(rng.randrange(1, 14)))
        own = rng.choice(frames).split(" ")
        for _ in range(rng.choice([0, 1, 1, 2])):
            own[rng.randrange(len(own))] = word()
        return " ".join(own) + rng.choice(["", " ", ". " + rng.choice(frames)])

    texts = [(i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in range(60)]
    texts += [(60, "10 20 30\n11 21 31\n12 22 32"), (61, "98 97 96\n95 94 93"), (62, "a 1 b"), (63, " \n\n"), (64, "x. \n. y")]
    assert against_sql(spark, tmp_path, texts) is None
