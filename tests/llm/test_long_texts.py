"""One very long text at a time: same results as in one piece, in memory a few times its size."""

import random
import subprocess
import sys

import numpy as np
import pytest

from fleetmeter.llm import batches, ngram_join, quality, toxicity
from tests.llm.conftest import ROOT

MB = 1 << 20
CALLS = {
    "ngram_join": "from fleetmeter.llm.ngram_join import shingle_sets as f; f(data, starts)",
    "quality": "from fleetmeter.llm.quality import _statistics as f; f(data, starts)",
    "quality_rules": "from fleetmeter.llm.quality_rules import counted_texts as f; f(data, starts)",
    "toxicity": "from fleetmeter.llm.toxicity import _distinct_grams as f; f(data)",
    "toxicity scores": "from fleetmeter.llm.toxicity import _hits, _lookup; g = np.arange(9, dtype=np.uint64); _hits(data, starts, g, _lookup(g))",
    "decontamination": "from fleetmeter.llm.decontamination import Windows; Windows({'a b': ['1']}).scan(data)",
}
SCRIPT = """
import resource, numpy as np
import fleetmeter.llm.batches, fleetmeter.llm.ngram_join, fleetmeter.llm.quality, fleetmeter.llm.toxicity, fleetmeter.llm.decontamination
data = b" ".join(b"w%%d" %% (i * 7919 %% 50021) for i in range(3_200_000))
starts = np.array([0, len(data)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
%s
print(len(data), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""


@pytest.mark.parametrize("name", CALLS)
def test_memory(name):
    run = subprocess.run([sys.executable, "-c", SCRIPT % CALLS[name]], cwd=ROOT, capture_output=True, text=True, check=True)
    size, more = map(int, run.stdout.split())
    assert size > 18 * MB and more < 14 * size


@pytest.mark.parametrize("seed", range(3))
def test_slices_change_nothing(monkeypatch, seed):
    rng = random.Random(seed)
    text = " ".join(rng.choice(["a", "bc", "É", " ", "\n", ".", "dd ee", "f" * 40]) for _ in range(300)).encode()
    starts = np.array([0, len(text)])
    grams = toxicity._distinct_grams(text.translate(toxicity._SIGNS_OUT))
    table = toxicity._lookup(grams[::3])
    whole = [ngram_join.shingle_sets(text, starts)[0], quality._statistics(text, starts)[0], grams,
             toxicity._hits(text.translate(toxicity._SIGNS_OUT), starts, grams[::3], table)[1]]
    for module in (batches, quality, toxicity):
        monkeypatch.setattr(module, "CHUNK_BYTES", 64)
    sliced = [ngram_join.shingle_sets(text, starts)[0], quality._statistics(text, starts)[0],
              toxicity._distinct_grams(text.translate(toxicity._SIGNS_OUT)),
              toxicity._hits(text.translate(toxicity._SIGNS_OUT), starts, grams[::3], table)[1]]
    for one, other in zip(whole, sliced):
        assert np.array_equal(one, other)
