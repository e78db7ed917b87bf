"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes ratios.

Features are the n-grams of 4 to 6 bytes that a text holds at all, over the text
lower-cased with ASCII signs as spaces. A feature's value is its log-count ratio
between toxic and other training texts; a logistic regression weighs them.

Defined cases: NULL and empty texts score by the intercept alone; rows without an
id are scored but never learned from; ids listed twice in the labels count twice;
with no label of one of the classes every score is 0.5; features as good as each other
are taken in the order of their bytes; an empty table gives no rows. A text longer than a
chunk is searched piece by piece. Rows keep their own columns.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.llm.batches import CHUNK_BYTES, LOWER, WORD_BYTES, field_place, row_slices, text_chunks

ORDERS = (4, 5, 6)
#: Training rows of each class, chosen by a hash of the id: the bound of the sample.
CLASS_ROWS = 3000
#: Features kept, those that tell the classes apart best.
FEATURES = 4096
LEAST_TEXTS = 3
THRESHOLD = 0.7

_SIGNS_OUT = bytes(b if WORD_BYTES[b] else 32 for b in LOWER)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def fold_of(id_column, parts):
    """crc32 of the id as text, modulo `parts`; NULL without an id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def _grams(data):
    """The 8 bytes that start at each byte, as integers."""
    padded = data + b"\0" * 8
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _mask(order):
    return np.uint64((1 << (8 * order)) - 1)


def _windows(data):
    """A long text in pieces of a chunk, each with the start of the next, so that no n-gram is cut."""
    for begin in range(0, max(len(data), 1), CHUNK_BYTES):
        yield data[begin:begin + CHUNK_BYTES + ORDERS[-1] - 1]


def _distinct_grams(data):
    found = np.zeros(0, np.uint64)
    for piece in _windows(data):
        grams = _grams(piece)
        own = [np.unique(grams[:max(0, len(piece) - order + 1)] & _mask(order)) for order in ORDERS]
        found = np.unique(np.concatenate([found, *own]))
    return found


def _counted(batches):
    """Partial counts: in how many toxic and other texts an n-gram occurs."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for first, starts, data in text_chunks(batch.column(0)):
            data = data.translate(_SIGNS_OUT)
            grams, positive = [], []
            for row in range(len(starts) - 1):
                own = _distinct_grams(data[starts[row]:starts[row + 1]])
                grams.append(own)
                positive.append(np.full(len(own), toxic[first + row], np.int64))
            keys, places = np.unique(np.concatenate(grams), return_inverse=True)
            ones = np.bincount(places, np.concatenate(positive), len(keys)).astype(np.int64)
            every = np.bincount(places, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(ones), pa.array(every)],
                names=["gram", "toxic", "texts"],
            )


def training_rows(docs, labels, id_column, text_column, label_column, class_rows, learnable):
    """Bounded labelled sample with its texts; (text as bytes, toxic)."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(learnable(known))
    sample = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(class_rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_column).alias("id"), F.expr(f"cast({text_column} as binary)").alias("text_utf8"))
    # At most twice `class_rows` short rows.
    return texts.join(F.broadcast(sample), "id").select("text_utf8", "toxic")


def _lookup(features):
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(features * _SPREAD) >> np.uint64(64 - _TABLE_BITS)] = True
    return table


def _hits(data, starts, features, table):
    """(text, feature) pairs of the texts in a chunk, each once."""
    if len(data) > CHUNK_BYTES + ORDERS[-1]:
        # One text, piece by piece.
        found = [_hits(piece, np.array([0, len(piece)]), features, table)[1] for piece in _windows(data)]
        own = np.unique(np.concatenate(found))
        return np.zeros(len(own), np.int64), own
    grams = _grams(data)
    found = []
    for order in ORDERS:
        own = grams & _mask(order)
        at = np.flatnonzero(table[(own * _SPREAD) >> np.uint64(64 - _TABLE_BITS)])
        if not len(at):
            continue
        place = np.minimum(np.searchsorted(features, own[at]), len(features) - 1)
        exact = features[place] == own[at]
        at, place = at[exact], place[exact]
        text = np.searchsorted(starts, at, "right") - 1
        inside = at + order <= starts[text + 1]
        found.append(text[inside] * len(features) + place[inside])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // len(features), keys % len(features)


class ToxicityModel:
    """Features (n-grams as integers, sorted), their weights, and the intercept."""

    def __init__(self, features, weights, intercept):
        self.features, self.weights, self.intercept = features, weights, intercept

    def scores(self, column):
        """Scores of a binary column of texts."""
        out = np.full(len(column), self.intercept)
        if len(self.features):
            table = _lookup(self.features)
            for first, starts, data in text_chunks(column):
                text, feature = _hits(data.translate(_SIGNS_OUT), starts, self.features, table)
                count = len(starts) - 1
                out[first:first + count] += np.bincount(text, self.weights[feature], count)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _log_ratio(counts, ones, zeros):
    toxic, other = counts[:, 0], counts[:, 1] - counts[:, 0]
    return np.log((toxic + 1) / (ones + 2)) - np.log((other + 1) / (zeros + 2))


def _fit_logistic(rows, columns, values, target, features, steps=400, penalty=1e-3):
    """Weights and intercept by Nesterov's accelerated gradient on sparse rows."""
    weight, intercept = np.zeros(features), float(np.log(target.mean() / (1 - target.mean())))
    ahead, ahead_intercept, speed = weight.copy(), intercept, 1.0
    size = np.bincount(rows, values * values, len(target)).max(initial=1.0) + 1
    rate = 4.0 / size
    for _ in range(steps):
        raw = np.bincount(rows, values * ahead[columns], len(target)) + ahead_intercept
        error = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - target) / len(target)
        # Each coordinate moves with the whole; the mean loss has curvature `size / 4`.
        new = ahead - rate * (np.bincount(columns, values * error[rows], features) + penalty * ahead)
        new_intercept = ahead_intercept - rate * error.sum()
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        pull = (speed - 1) / faster
        ahead, ahead_intercept = new + pull * (new - weight), new_intercept + pull * (new_intercept - intercept)
        weight, intercept, speed = new, new_intercept, faster
    return weight, intercept


def train(docs, labels, id_column="doc_id", text_column="text", label_column="toxic",
          class_rows=CLASS_ROWS, features=FEATURES, learnable=lambda known: F.lit(True)):
    """A model of at most `class_rows` labelled rows of each class.

    `learnable` takes the labels (columns id, toxic) and says which may be learned.
    Only the counts of the chosen features, the ratios and the positions of features
    in the sample reach the driver.
    """
    rows = training_rows(docs, labels, id_column, text_column, label_column, class_rows, learnable)
    totals = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    every, ones = int(totals[0]), int(totals[1])
    zeros = every - ones
    if not ones or not zeros:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    counted = rows.mapInArrow(_counted, "gram bigint, toxic bigint, texts bigint")
    counted = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
    share, base = F.col("toxic") / ones, (F.col("texts") - F.col("toxic")) / zeros
    spread = F.sqrt(F.col("texts") / every * (1.0001 - F.col("texts") / every) * (1 / ones + 1 / zeros))
    best = counted.where(F.col("texts") >= LEAST_TEXTS).orderBy(
        F.desc(F.abs(share - base) / spread), "gram"
    ).limit(features).collect()
    if not best:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(ones / zeros)))
    grams = np.array([r["gram"] for r in best], np.int64).astype(np.uint64)
    order = np.argsort(grams)
    grams = grams[order]
    counts = np.array([(r["toxic"], r["texts"]) for r in best], float)[order]
    ratio = _log_ratio(counts, ones, zeros)

    def positions(batches):
        table = _lookup(grams)
        for batch in batches:
            lists = [[] for _ in range(batch.num_rows)]
            for first, starts, data in text_chunks(batch.column(0)):
                text, feature = _hits(data.translate(_SIGNS_OUT), starts, grams, table)
                for row, own in zip(text, feature):
                    lists[first + row].append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["toxic", "own"]
            )

    held = rows.mapInArrow(positions, "toxic int, own array<int>").collect()
    target = np.array([r["toxic"] for r in held], float)
    columns = np.array([c for r in held for c in r["own"]], np.int64)
    places = np.repeat(np.arange(len(held)), [len(r["own"]) for r in held])
    weight, intercept = _fit_logistic(places, columns, ratio[columns], target, len(grams))
    return ToxicityModel(grams, weight * ratio, intercept)


def _scorer(shared, place):
    """Adds the score of the text, field number `place` of `row`."""

    def score(batches):
        for batch in batches:
            for piece, texts in row_slices(batch, place):
                scores = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores)], names=["row", "score"])

    return score


def scored(docs, model, text_column="text"):
    """(row, score): the rows of `docs` as they are, and the score of their text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(shared, field_place(docs, text_column)), schema)
