"""URL filters: glob rules as one bit-parallel wildcard automaton.

All rules together are one automaton whose states are bits of a few 64-bit words.
Reading a letter moves every state of every rule at once: states whose next letter
it is shift forward, states at a star that takes it stay. A batch of URLs is read in
step, one column of letters at a time.

A glob has `**` for any run of letters and `*` for a run without `/`. It is held
against the canonical URL: a dot, the host with A-Z lower-cased, and the path.

Defined cases: a NULL URL, or one without `://`, has an empty host and path and fits
only globs that fit a lone dot; rules listed twice count once; with no rules every
URL takes the default; URLs of any length are read whole.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Read together; with the rules' words this bounds the arrays of a task.
URLS_AT_ONCE = 4096

# Rules of the contract: (verdict, rule); a rule is a host and the start of a path.
HOST_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
# Our own, for URLs that no rule fits: hosts that serve advertisements or trackers,
# and files that hold no text.
OWN_BLOCKED = (
    "*.ads.**", "*.adserver.**", "*.tracker.**", "*.tracking.**", "*.doubleclick.**",
    "**.exe", "**.zip", "**.mp4", "**.jpg", "**.png", "**/cgi-bin/**",
)


def rule_glob(rule):
    """The glob of a host rule: its host or a subdomain of it, then a path that starts so."""
    return f"*.{rule}**"


def _parts(glob):
    return re.findall(r"\*\*|\*|[^*]", glob)


class GlobAutomaton:
    """Globs packed one after another into 64-bit words.

    A glob of n letters has n + 1 states: bit k is set where k letters are read.
    """

    def __init__(self, globs):
        self.globs = list(globs)
        states = [sum(1 for p in _parts(g) if p[0] != "*") + len(
            [1 for p in _parts(g) if p[0] != "*" for _ in p.encode()[1:]]) + 1 for g in self.globs]
        words = max(1, -(-sum(states) // 64))
        self.starts = np.zeros(words, np.uint64)
        self.moves = np.zeros((256, words), np.uint64)
        self.stays = np.zeros((256, words), np.uint64)
        self.ends = []
        at = 0

        def put(target, bit):
            target[bit // 64] |= np.uint64(1 << (bit % 64))

        for glob in self.globs:
            put(self.starts, at)
            for part in _parts(glob):
                if part[0] == "*":
                    for letter in range(256):
                        if part == "**" or letter != ord("/"):
                            put(self.stays[letter], at)
                    continue
                for letter in part.encode():
                    at += 1
                    put(self.moves[letter], at)
            self.ends.append(at)
            at += 1

    def fits(self, texts):
        """Matrix of which of the UTF-8 texts fits which glob."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        out = np.zeros((len(texts), len(self.globs)), bool)
        for begin in range(0, len(texts), URLS_AT_ONCE):
            chosen = order[begin:begin + URLS_AT_ONCE]
            out[chosen] = self._fits([texts[i] for i in chosen])
        return out

    def _fits(self, texts):
        """The same of texts sorted by falling length: those still read come first."""
        sizes = np.array([len(t) for t in texts])
        joined = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.tile(self.starts, (len(texts), 1))
        active = len(texts)
        one, top = np.uint64(1), np.uint64(63)
        for column in range(int(sizes[0]) if len(sizes) else 0):
            while active and sizes[active - 1] <= column:
                active -= 1
            letters = joined[begins[:active] + column]
            now = state[:active]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:active] = (shifted & self.moves[letters]) | (now & self.stays[letters])
        return np.column_stack([
            (state[:, end // 64] >> np.uint64(end % 64)) & one == one for end in self.ends
        ]) if self.ends else np.zeros((len(texts), 0), bool)


_ADDRESS = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def host_and_path(url):
    """Host, A-Z lower-cased, and path; both empty without `://`."""
    begin = -1 if url is None else url.find("://")
    if begin < 0:
        return "", ""
    host = _ADDRESS.match(url, begin + 3)
    lowered = host.group().translate(_LOWERED)
    return lowered, _PATH.match(url, host.end()).group()


_LOWERED = {c: c + 32 for c in range(65, 91)}


def judged(pages, url_column="url", host_rules=HOST_RULES, own_blocked=OWN_BLOCKED, default="allow"):
    """(row, host, path, rule, verdict): the longest rule that fits, else our own globs."""
    ranked = sorted(dict.fromkeys(host_rules), key=lambda r: (-len(r[1]), r[1]))
    globs = [rule_glob(rule) for _, rule in ranked] + list(dict.fromkeys(own_blocked))

    def judge(batches):
        automaton = GlobAutomaton(globs)
        for batch in batches:
            parts = [host_and_path(url) for url in batch.column(1).to_pylist()]
            fits = automaton.fits([f".{host}{path}".encode() for host, path in parts])
            ruled, own = fits[:, :len(ranked)], fits[:, len(ranked):].any(axis=1)
            first = np.where(ruled.any(axis=1), ruled.argmax(axis=1) if len(ranked) else 0, -1)
            rules = [ranked[i][1] if i >= 0 else None for i in first]
            verdicts = [
                ranked[i][0] if i >= 0 else "block" if blocked else default
                for i, blocked in zip(first, own)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in parts], pa.string()),
                 pa.array([p[1] for p in parts], pa.string()),
                 pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["row", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col(url_column).alias("url"))
    schema = T.StructType([
        rows.schema["row"], *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    ])
    return rows.mapInArrow(judge, schema)
