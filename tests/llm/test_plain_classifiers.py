"""The trained classifiers against fits written out plainly, on dense matrices and Python counts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmeter.llm import quality, toxicity


def _corpus(seed):
    rng = random.Random(seed)
    calm = ["river", "stone", "Morning", "window", "garden", "letter", "42", "winter", "é", "été!", "THE", "of", "a", "a"]
    rows, labels = [], []
    for i in range(160):
        marked = i % 3 == 0
        own = [rng.choice(calm) for _ in range(rng.randint(3, 60))]
        if marked:
            own[rng.randrange(len(own))] = rng.choice(["moron", "you, fool", "scum"])
            own += ["!!!"] * rng.randrange(3)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(own) + rng.choice(["", ".", "\n"])))
        labels.append((i, int(marked if rng.random() < 0.93 else not marked)))
    return rows + [(500, None), (501, "")], labels


def _signs_out(text):
    data = (text or "").encode()
    return bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isascii() and chr(b).isalnum() or b >= 128 else 32 for b in data)


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_equals_a_plain_fit(spark, documents, seed):
    rows, labels = _corpus(seed)
    learned = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    texts = {i: _signs_out(t) for i, t in rows}
    grams = {i: {t[a:a + n] for n in (4, 5, 6) for a in range(len(t) - n + 1)} for i, t in texts.items()}
    every, ones = len(learned), sum(learned.values())
    zeros = every - ones
    held = Counter(g for i in learned for g in grams[i])
    toxic = Counter(g for i, y in learned.items() if y for g in grams[i])

    def worth(gram):
        texts_with, bad = held[gram], toxic[gram]
        spread = np.sqrt(texts_with / every * (1.0001 - texts_with / every) * (1 / ones + 1 / zeros))
        return abs(bad / ones - (texts_with - bad) / zeros) / spread

    known = sorted((g for g in held if held[g] >= toxicity.LEAST_TEXTS), key=lambda g: (-worth(g), int.from_bytes(g, "little")))[:60]
    ratio = {g: np.log((toxic[g] + 1) / (ones + 2)) - np.log((held[g] - toxic[g] + 1) / (zeros + 2)) for g in known}
    table = np.array([[ratio[g] * (g in grams[i]) for g in known] + [1.0] for i in learned])
    target = np.array(list(learned.values()), float)
    # Newton's steps of the mean loss with a penalty on all weights but the last.
    weights = np.zeros(len(known) + 1)
    penalty = np.r_[np.full(len(known), 1e-3), 0.0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-table @ weights))
        slope = table.T @ (p - target) / every + penalty * weights
        curve = table.T @ (table * (p * (1 - p) / every)[:, None]) + np.diag(penalty) + 1e-12 * np.eye(len(weights))
        weights -= np.linalg.solve(curve, slope)
    docs = documents(rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), features=60,
                           learnable=lambda _: toxicity.fold_of("id", 3) != 1)
    assert set(model.features.tolist()) == {int.from_bytes(g, "little") for g in known}
    # The fit takes a stated number of steps: it ends near the least loss and not at it.
    own = {g: model.weights[list(model.features).index(int.from_bytes(g, "little"))] for g in known}
    chosen = np.array([own[g] / ratio[g] for g in known] + [model.intercept])

    def loss(w):
        raw = table @ w
        return np.mean(np.log1p(np.exp(raw)) - target * raw) + 5e-4 * w[:-1] @ w[:-1]

    assert loss(weights) <= loss(chosen) <= loss(weights) + 5e-4
    plain = {i: 1 / (1 + np.exp(-(sum(own[g] for g in known if g in grams[i]) + model.intercept))) for i in texts}
    found = {r[0]: r[1] for r in toxicity.scored(docs, model).select("row.doc_id", "score").collect()}
    assert found == pytest.approx(plain, abs=1e-9)


def _plain_statistics(text):
    data = (text or "").encode()
    kinds = Counter("abcdefghi"[int(k)] for k in quality._KINDS[list(data)]) if data else Counter()
    words = [w for w in bytes(32 if b in (9, 10, 11, 12, 13) else b for b in data).split(b" ") if w]
    size, many = max(len(data), 1), max(len(words), 1)
    lengths = np.array([min(len(w), 64) for w in words], float)
    mean = lengths.sum() / many
    pairs = list(zip([None, *words[:-1]], words))
    return [np.log1p(len(data)), *[kinds["abcdefghi"[k]] / size for k in (1, 2, 3, 4, 5, 6, 7, 0)], mean,
            np.sqrt(max((lengths ** 2).sum() / many - mean * mean, 0)), len(set(words)) / many ** 0.8,
            sum(a == b for a, b in pairs) / many, (lengths <= 3).sum() / many,
            np.log1p(len(words) / (kinds["f"] + 1)), np.log1p(len(words)), len(set(pairs)) / many]


def _pooled(values):
    """Textbook pool-adjacent-violators on (mean, weight) of the bins that have rows."""
    blocks = []
    for place, (mean, weight) in values:
        blocks.append([mean, weight, [place]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, weight, places = blocks.pop()
            last = blocks[-1]
            blocks[-1] = [(last[0] * last[1] + mean * weight) / (last[1] + weight), last[1] + weight, last[2] + places]
    return {place: mean for mean, _, places in blocks for place in places}


@pytest.mark.parametrize("seed", [3, 4])
def test_quality_equals_a_plain_fit(spark, documents, seed):
    rows, labels = _corpus(seed)
    docs = documents(rows)
    stats = {i: _plain_statistics(t) for i, t in rows}
    measured = {r["id"]: r["stats"] for r in quality.statistics(docs).collect()}
    assert all(measured[i] == pytest.approx(stats[i], abs=1e-12) for i in stats)
    learned = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    apart = {r[0]: r[1] for r in known.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).collect()}
    table = np.array([stats[i] for i in learned])
    spread = table.std(axis=0)
    model = quality.QualityModel(table.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), None, None)
    fit = [i for i in learned if not apart[i]]
    waves, target = model.cosines(np.array([stats[i] for i in fit])), np.array([learned[i] for i in fit], float)
    weigh = np.eye(waves.shape[1]) * quality.PENALTY * len(fit) * (waves[0, 0] ** 2)
    weigh[0, 0] = 1e-9
    # The same minimum by least squares on the stacked system.
    stacked = np.vstack([waves, np.sqrt(weigh)])
    model.weights = np.linalg.lstsq(stacked, np.r_[target, np.zeros(len(weigh))], rcond=None)[0]
    bins = {}
    for i in (i for i in learned if apart[i]):
        bins.setdefault(int(quality.bins_of(model.raw(np.array([stats[i]])))[0]), []).append(learned[i])
    steps = _pooled([(b, (np.mean(v), len(v))) for b, v in sorted(bins.items())])
    found = {r["id"]: r["score"] for r in quality.quality(
        docs, known, learnable=lambda _: toxicity.fold_of("id", 4) != 2).collect()}
    for i in stats:
        place = int(quality.bins_of(model.raw(np.array([stats[i]])))[0])
        if place in steps:
            assert found[i] == pytest.approx(steps[place], abs=1e-6)
        else:
            # Between bins with rows: no lower than the one before, no higher than the one after.
            assert found[i] >= max([v for b, v in steps.items() if b < place], default=0) - 1e-6
            assert found[i] <= min([v for b, v in steps.items() if b > place], default=1) + 1e-6
