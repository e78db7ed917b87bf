"""Quality: kernel ridge regression on document statistics, by random Fourier features.

Statistics of a whole text are standardised and mapped to random cosines whose inner
products approximate a Gaussian kernel. Ridge weights solve normal equations whose
entries are summed over the partitions. Scores are calibrated by isotonic regression
on labelled rows the weights have not seen.

Defined cases: NULL and empty texts have the statistics of an empty text; rows
without an id are scored but never learned from; ids listed twice in the labels count
twice; with labels of one class only every score is 0.5; an empty table gives no rows. A text
longer than a chunk is measured slice by slice. Columns other than the two named are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.llm.batches import (
    CHUNK_BYTES, SOLID_BYTES, hashed_runs, slices, text_chunks, word_bounds, word_hashes,
)
from fleetmeter.sources.staging import staged

COSINES = 192
BANDWIDTH = 0.12
PENALTY = 1e-3
SEED = 20
#: Score steps on which the calibration is kept.
BINS = 2000
THRESHOLD = 0.7

_KINDS = np.zeros(256, np.uint8)
_KINDS[ord("a"):ord("z") + 1] = 1
_KINDS[ord("A"):ord("Z") + 1] = 2
_KINDS[ord("0"):ord("9") + 1] = 3
_KINDS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_KINDS[0x0A] = 5
_KINDS[list(b".,;:?'\"-()")] = 6
_KINDS[list(b"!")] = 7
_KINDS[128:] = 8
_N_KINDS = 9

STATISTICS = (
    "log length", "lower share", "upper share", "digit share", "blank share", "line share",
    "stop share", "shout share", "other sign share", "mean word", "word spread",
    "distinct words", "repeated neighbour", "short words", "words per line", "log words",
    "distinct pairs",
)


def _kinds_and_words(data, starts):
    """Bytes of each kind by text, hashes and lengths of the words, and the words before each text."""
    texts = len(starts) - 1
    if len(data) <= CHUNK_BYTES:
        raw = np.frombuffer(data, np.uint8)
        owner = np.repeat(np.arange(texts), np.diff(starts))
        kinds = np.bincount(owner * _N_KINDS + _KINDS[raw], minlength=texts * _N_KINDS)
        begins, ends, at = word_bounds(raw, starts, SOLID_BYTES)
        return kinds.reshape(texts, _N_KINDS), word_hashes(raw, begins, ends), ends - begins, at
    # One text, slice by slice.
    kinds, lengths = np.zeros((1, _N_KINDS), np.int64), []
    for begin in range(0, len(data), CHUNK_BYTES):
        piece = np.frombuffer(data, np.uint8, min(CHUNK_BYTES, len(data) - begin), begin)
        kinds[0] += np.bincount(_KINDS[piece], minlength=_N_KINDS)
    for begin, end, whole in slices(data, SOLID_BYTES):
        if whole:
            lengths.append(np.array([end - begin]))
        else:
            piece = np.frombuffer(data, np.uint8, end - begin, begin)
            begins, ends, _ = word_bounds(piece, np.array([0, len(piece)]), SOLID_BYTES)
            lengths.append(ends - begins)
    hashes, at, _ = hashed_runs(data, starts, SOLID_BYTES)
    return kinds, hashes, np.concatenate(lengths), at


def _statistics(data, starts):
    """One row of STATISTICS for each text of a chunk."""
    texts = len(starts) - 1
    kinds, hashes, lengths, at = _kinds_and_words(data, starts)
    kinds = kinds.astype(float)
    size = np.maximum(np.diff(starts), 1).astype(float)
    words = np.diff(at).astype(float)
    many = np.maximum(words, 1)
    word_owner = np.repeat(np.arange(texts), np.diff(at))
    lengths = np.minimum(lengths, 64).astype(float)
    mean = np.bincount(word_owner, lengths, texts) / many
    square = np.bincount(word_owner, lengths * lengths, texts) / many
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    pairs = hashes.copy()
    pairs[1:] += hashes[:-1] * np.uint64(31)
    # A text's first word follows none, whatever stands before it in the chunk.
    first = at[:-1][np.diff(at) > 0]
    pairs[first] = hashes[first]
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1], at[1:])], float)
    distinct_pairs = np.array([len(np.unique(pairs[a:b])) for a, b in zip(at[:-1], at[1:])], float)
    return np.column_stack([
        np.log1p(np.diff(starts)), kinds[:, 1] / size, kinds[:, 2] / size, kinds[:, 3] / size,
        kinds[:, 4] / size, kinds[:, 5] / size, kinds[:, 6] / size, kinds[:, 7] / size,
        kinds[:, 0] / size, mean, np.sqrt(np.maximum(square - mean * mean, 0)),
        # A long text repeats words anyway: the share is taken against a root of its size.
        distinct / many ** 0.8, np.bincount(word_owner, same, texts) / many,
        np.bincount(word_owner, lengths <= 3, texts) / many,
        np.log1p(words / (kinds[:, 5] + 1)), np.log1p(words), distinct_pairs / many,
    ])


def statistics(docs, id_column="doc_id", text_column="text"):
    """(id, stats) of every row."""

    def measure(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, len(STATISTICS)))
            for first, starts, data in text_chunks(batch.column(1)):
                out[first:first + len(starts) - 1] = _statistics(data, starts)
            values = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), values.cast(pa.list_(pa.float64()))], names=["id", "stats"]
            )

    rows = docs.select(F.col(id_column).alias("id"), F.expr(f"cast({text_column} as binary)").alias("text_utf8"))
    schema = T.StructType([rows.schema["id"], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(measure, schema)


class QualityModel:
    """Standardisation, cosines, ridge weights and calibration steps."""

    def __init__(self, mean, spread, weights, steps):
        self.mean, self.spread, self.weights, self.steps = mean, spread, weights, steps
        draw = np.random.default_rng(SEED)
        count = len(mean)
        self.turns = draw.normal(size=(count, COSINES)) * np.sqrt(2 * BANDWIDTH)
        self.shifts = draw.uniform(0, 2 * np.pi, COSINES)

    def cosines(self, stats):
        scaled = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.cos(scaled @ self.turns + self.shifts) * np.sqrt(2 / COSINES)
        return np.column_stack([np.ones(len(stats)), waves])

    def raw(self, stats):
        return self.cosines(stats) @ self.weights

    def scores(self, stats):
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return self.steps[bins_of(self.raw(stats))]


def bins_of(raw):
    """Steps of -0.5 to 1.5."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def _matrix(batch):
    """Statistics of a batch as a matrix."""
    column = batch.column(batch.schema.names.index("stats"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(STATISTICS))


def isotonic(sums, counts):
    """Non-decreasing means of neighbouring bins, by pooling those out of order."""
    blocks = []
    for total, count, width in zip(sums, counts, np.ones(len(sums), int)):
        blocks.append([total, count, width])
        while len(blocks) > 1 and (
            blocks[-1][1] == 0 or blocks[-2][1] == 0
            or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]
        ):
            total, count, width = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
            blocks[-1][2] += width
    return np.concatenate([np.full(w, t / c if c else 0.5) for t, c, w in blocks])


def train(measured, labels, id_column="doc_id", label_column="quality",
          learnable=lambda known: F.lit(True)):
    """A model from all labelled rows; `measured` is a written table of statistics.

    Three in four labelled rows, by a hash of the id, enter the normal equations, the
    others the calibration. The driver gets sums: COSINES^2 of the equations, BINS of
    the calibration.
    """
    spark = measured.sparkSession
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("good"))
    known = known.where(F.col("id").isNotNull() & F.col("good").isin(0, 1))
    known = known.where(learnable(known))
    rows = measured.join(known, "id").select(
        "stats", "good", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("calibrates")
    )
    rows = staged(rows, "quality-labelled")
    sizes = rows.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    columns = len(STATISTICS)
    neutral = QualityModel(np.zeros(columns), np.ones(columns), None, None)
    if not 0 < sizes[1] < sizes[0]:
        return neutral
    moments = rows.agg(*[
        f(F.col("stats")[i]) for i in range(columns) for f in (F.avg, F.stddev_pop)
    ]).first()
    mean, spread = np.array(moments[0::2], float), np.array(moments[1::2], float)
    model = QualityModel(mean, np.where(spread > 1e-9, spread, 1.0), None, None)
    fitting = rows.where("NOT calibrates")
    held = rows.where("calibrates").agg(F.min("good"), F.max("good")).first()
    fit_size = fitting.agg(F.min("good"), F.max("good")).first()
    if (fit_size[0], fit_size[1]) != (0, 1) or (held[0], held[1]) != (0, 1):
        # Too few labels to keep some apart: all serve both ends.
        fitting, calibrating = rows, rows
    else:
        calibrating = rows.where("calibrates")
    shared = spark.sparkContext.broadcast(model)
    width = COSINES + 1

    def equations(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            waves = shared.value.cosines(_matrix(batch))
            target = batch.column(batch.schema.names.index("good")).to_numpy(zero_copy_only=False)
            total += waves.T @ np.column_stack([waves, target])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(total.ravel()[at])], names=["entry", "value"]
        )

    sums = fitting.select("stats", "good").mapInArrow(equations, "entry bigint, value double")
    solved = np.zeros(width * (width + 1))
    for entry, value in sums.groupBy("entry").agg(F.sum("value")).collect():
        solved[entry] = value
    solved = solved.reshape(width, width + 1)
    weigh = np.eye(width) * PENALTY * max(1.0, solved[0, 0])
    weigh[0, 0] = 1e-9
    model.weights = np.linalg.solve(solved[:, :width] + weigh, solved[:, width])
    fitted = spark.sparkContext.broadcast(model)

    def binned(batches):
        for batch in batches:
            places = bins_of(fitted.value.raw(_matrix(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(places), batch.column(1)], names=["bin", "good"])

    steps = calibrating.select("stats", "good").mapInArrow(binned, "bin bigint, good int")
    totals, counts = np.zeros(BINS), np.zeros(BINS)
    for place, total, count in steps.groupBy("bin").agg(F.sum("good"), F.count("*")).collect():
        totals[place], counts[place] = total, count
    model.steps = isotonic(totals, counts)
    return model


def scored(measured, model):
    """(id, score) of every measured row."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.scores(_matrix(batch)))], names=["id", "score"]
            )

    schema = T.StructType([measured.schema["id"], T.StructField("score", T.DoubleType())])
    return measured.select("id", "stats").mapInArrow(score, schema)


def quality(docs, labels, id_column="doc_id", text_column="text", label_column="quality",
            learnable=lambda known: F.lit(True)):
    """(id, score) of every row; statistics are measured once and written."""
    measured = staged(statistics(docs, id_column, text_column), "quality-statistics")
    return scored(measured, train(measured, labels, id_column, label_column, learnable))
