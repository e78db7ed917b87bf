"""Rows that pass through Python carry their text once and come back in slices of bounded bytes."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fleetmeter.llm import batches, bpe, decontamination, toxicity

GRAMS = np.sort(np.frombuffer(b"a b \0\0\0\0ord1\0\0\0\0", np.uint64))
MADE = {
    "toxicity": lambda spark, docs, name: toxicity.scored(
        docs, toxicity.ToxicityModel(GRAMS, np.array([1.5, -2.0]), 0.25), name),
    "bpe": lambda spark, docs, name: bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), name),
    "decontamination": lambda spark, docs, name: decontamination.decontaminated(
        docs, spark.createDataFrame([(7, "b word8 a b")], "item_id long, text string"), text_column=name),
}


def _text(i):
    return None if i % 7 == 0 else "" if i % 11 == 0 else f"word{i} a b " * (i * 13 % 1500)


@pytest.mark.parametrize("name", MADE)
def test_slices(spark, documents, monkeypatch, name):
    docs = documents([(i, _text(i)) for i in range(600)]).coalesce(1)
    size = sum(len(_text(i) or "") for i in range(600))
    assert size > 3 * batches.CHUNK_BYTES
    passed, spark_own = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda rows, function, schema: (
        passed.append((rows, function)), spark_own(rows, function, schema))[1])
    found = MADE[name](spark, docs, "text").collect()
    rows, function = passed[-1]
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    assert batch.num_rows == 600 and batch.nbytes < 1.2 * size
    out = list(function(iter([batch])))
    assert len(out) > 3
    for part in out:
        assert sum(len(r["text"] or "") for r in part.column(0).to_pylist()) <= batches.CHUNK_BYTES
    assert [r["doc_id"] for part in out for r in part.column(0).to_pylist()] == list(range(600))
    # Text by text: the same as in slices.
    alone = [r for i in range(600) for r in pa.Table.from_batches(function(iter([batch.slice(i, 1)]))).to_pylist()]
    assert [{**r, "row": None} for r in pa.Table.from_batches(out).to_pylist()] == [{**r, "row": None} for r in alone]
    assert [r["row"]["text"] for r in alone] == [_text(i) for i in range(600)] == [r["row"]["text"] for r in found]
    assert MADE[name](spark, docs, "Text").collect() == found


def test_one_text_longer_than_a_slice():
    texts = ["ab", "c" * (batches.CHUNK_BYTES + 5), None, "", "de"]
    rows = pa.array([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    batch = pa.RecordBatch.from_arrays([rows], names=["row"])
    found = [(part.column(0).to_pylist(), own.to_pylist()) for part, own in batches.row_slices(batch, 1)]
    assert [len(part) for part, _ in found] == [1, 1, 3]
    assert [r["text"] for part, _ in found for r in part] == texts
    assert [t for _, own in found for t in own] == [t and t.encode() if t is not None else None for t in texts[:3]] + [b"", b"de"]
    assert list(batches.row_slices(batch.slice(0, 0), 1)) == []


def test_counts_of_training_texts_follow_chunks():
    texts = [(f"toxic{i % 50} text " * 3000).encode() for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(60)], pa.int32())], names=["t", "y"])
    parts = list(toxicity._counted(iter([batch])))
    assert len(parts) == len(list(batches.text_chunks(batch.column(0)))) > 1
    found = Counter()
    for part in parts:
        for gram, toxic, every in zip(*[c.to_pylist() for c in part.columns]):
            found[gram, "toxic"] += toxic
            found[gram, "every"] += every
    wanted = Counter()
    for i, text in enumerate(texts):
        for gram in toxicity._distinct_grams(text).astype(np.int64).tolist():
            wanted[gram, "toxic"] += i % 2
            wanted[gram, "every"] += 1
    assert +found == +wanted
