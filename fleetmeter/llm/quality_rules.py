"""Quality rules judged by host.

Each text is counted once; rules are tests of the counts. Failures are added up by
host and rule. A host with few documents says little by itself: its rate is shrunk
towards the rate of all hosts by a beta prior whose mean and weight are fitted to
the spread of the hosts' rates (method of moments, with sampling noise taken off). A
host that fails a rule more often than that rule allows is rejected, and its verdict
goes back to each of its documents. Documents also go for the base rules by themselves.

The counts, a few numbers for each document, are written once; the host totals, the
prior and the verdicts read them. Totals are combined before their shuffle, so a host
that holds a third of all documents is a row from each task.

Defined cases: NULL and empty texts have no words and fail the base rule; NULL hosts are
one host; repeated rows count each; no documents give no rows; with one host, or rates no
further apart than chance, every host gets the rate of all. A text longer than a chunk is
taken slice by slice and leaves 8 bytes for each word and line. Rows keep their columns.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.llm.batches import CHUNK_BYTES, SOLID_BYTES, hashed_runs, mixed, text_chunks
from fleetmeter.sources.staging import staged

# The base rules.
WINDOW_WORDS = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

#: Further rules of ours, in percent.
SYMBOL_PERCENT = 10
DUPLICATE_LINES_PERCENT = 30
WORD_LENGTHS = (2, 15)

#: Shrunk rate of failures above which a host is rejected: most of its documents fail the rule.
HOST_RATE = 0.5

#: Bounds of the prior's share of a rate's spread (0: hosts are all alike, 1: they have nothing in common).
LEAST_SPREAD, MOST_SPREAD = 1e-6, 1 - 1e-6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[list(SYMBOLS)] = True
_LINE_BYTES = np.ones(256, bool)
_LINE_BYTES[ord("\n")] = False
#: Bytes that open a code point inside a word.
_POINT_BYTES = SOLID_BYTES.copy()
_POINT_BYTES[0x80:0xC0] = False

_TERMS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93,
                   0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _bytes_by_text(data, starts, table):
    """Number of bytes of `table` in each text of a chunk."""
    total = np.zeros(len(starts) - 1, np.int64)
    if len(data) > CHUNK_BYTES:
        array = np.frombuffer(data, np.uint8)
        total[0] = sum(int(table[array[i:i + CHUNK_BYTES]].sum()) for i in range(0, len(array), CHUNK_BYTES))
        return total
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[np.frombuffer(data, np.uint8)], out=sums[1:])
    return np.diff(sums[starts])


def _duplicates(keys):
    """For each key the number of equal ones, and whether it is the first of them."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    opening = np.zeros(len(keys), bool)
    opening[first] = True
    return counts[inverse], opening


def _of_text(hashes, at):
    """The hashes, told apart by the text they stand in."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return mixed(hashes ^ mixed(text.astype(np.uint64) + np.uint64(1)))


def _sum_by_text(flags, at):
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def _repeated_words(hashes, at):
    """Words inside windows that their text holds twice or more."""
    count = len(hashes)
    inside = np.zeros(count, bool)
    if count >= WINDOW_WORDS:
        windows = count - WINDOW_WORDS + 1
        sums = np.zeros(windows, np.uint64)
        for i, term in enumerate(_TERMS):
            sums += mixed(hashes[i:i + windows] * term + np.uint64(i))
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        whole = np.flatnonzero(text[:windows] == text[WINDOW_WORDS - 1:])
        keys = mixed(sums[whole] ^ mixed(text[whole].astype(np.uint64) + np.uint64(1)))
        found = whole[_duplicates(keys)[0] > 1] if len(whole) else whole
        for i in range(WINDOW_WORDS):
            inside[found + i] = True
    return _sum_by_text(inside, at)


def counted_texts(data, starts):
    """COUNTS of each text of a chunk, as columns."""
    words, at, _ = hashed_runs(data, starts, SOLID_BYTES)
    lines, line_at, holds = hashed_runs(data, starts, _LINE_BYTES, SOLID_BYTES)
    keys = _of_text(lines, line_at)
    later = np.zeros(len(lines), bool)
    if len(lines):
        later = ~_duplicates(keys)[1] & holds
    return [
        np.diff(at), _bytes_by_text(data, starts, _POINT_BYTES), _bytes_by_text(data, starts, _SYMBOL_BYTES),
        _sum_by_text(holds, line_at), _sum_by_text(later, line_at), _repeated_words(words, at),
    ]


def statistics(docs, text_column="text"):
    """(row, *COUNTS): the rows of `docs` without their text, and the counts of the text."""

    def count(batches):
        for batch in batches:
            found = [[] for _ in COUNTS]
            for _, starts, data in text_chunks(batch.column(1)):
                for column, own in zip(found, counted_texts(data, starts)):
                    column.append(own)
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *COUNTS])

    others = [F.col(f"`{name}`") for name in docs.columns if name != text_column]
    rows = docs.select(F.struct(*others).alias("row"), F.expr(f"cast(`{text_column}` as binary)").alias("text_utf8"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType(), False) for c in COUNTS]])
    return rows.mapInArrow(count, schema)


def rules():
    """Name -> failed, over the counts; the first two are the base rules."""
    words = F.col("n_words")
    return {
        "few_words": words < LEAST_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > REPEATED_PERCENT * words,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * words,
        "duplicate_lines": 100 * F.col("n_dup_lines") > DUPLICATE_LINES_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < WORD_LENGTHS[0] * words) | (F.col("word_chars") > WORD_LENGTHS[1] * words),
    }


def base_failed():
    return rules()["few_words"] | rules()["repeated_words"]


def host_totals(counted, host="host"):
    """(host, rule, documents, failures)."""
    totals = counted.groupBy(host).agg(
        F.count("*").alias("documents"), *[F.count_if(failed).alias(name) for name, failed in rules().items()])
    by_rule = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failures")) for name in rules()])
    return totals.select(F.col(host).alias("host"), "documents", F.explode(by_rule).alias("of")).select(
        "host", "of.rule", "documents", "of.failures")


def priors(totals):
    """(rule, mean, weight): the beta prior of each rule; `weight` counts as so many documents.

    The hosts' weighted spread about the mean, less what drawing the documents of equal
    hosts would give, says how much of it belongs to the hosts.
    """
    sums = totals.groupBy("rule").agg(
        F.count("*").alias("hosts"), F.sum("documents").alias("n"), F.sum("failures").alias("f"),
        F.sum(F.col("documents").cast("double") * F.col("documents")).alias("nn"),
        F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("documents")).alias("ff"),
    ).withColumn("mean", F.col("f") / F.col("n"))
    noise = F.col("mean") * (1 - F.col("mean"))
    spread = F.col("ff") - F.col("n") * F.col("mean") * F.col("mean")
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("hosts") - 1)
    share = F.try_divide(spread - noise * (F.col("hosts") - 1), noise * room)
    bounded = F.greatest(F.lit(LEAST_SPREAD), F.least(F.lit(MOST_SPREAD), F.coalesce(share, F.lit(0.0))))
    return sums.select("rule", "mean", ((1 - bounded) / bounded).alias("weight"))


def host_verdicts(totals, rate=HOST_RATE):
    """(host, rule, documents, failures, rate, rejected): shrunk rates and what follows."""
    shrunk = (F.col("weight") * F.col("mean") + F.col("failures")) / (F.col("weight") + F.col("documents"))
    # One row for each rule.
    return totals.join(F.broadcast(priors(totals)), "rule").select(
        "host", "rule", "documents", "failures", shrunk.alias("rate"), (shrunk > rate).alias("rejected"))


def judged(docs, host_column="source", text_column="text", rate=HOST_RATE):
    """(row, *COUNTS, base_failed, host_rejected_by, kept): every row with its verdict.

    `row` has the columns of `docs` but the text. `host_rejected_by` lists the rules for
    which the document's host is rejected.
    """
    counted = staged(statistics(docs, text_column).select(
        "*", F.col(f"row.`{host_column}`").cast("string").alias("host")), "quality-counts")
    verdicts = host_verdicts(staged(host_totals(counted), "quality-hosts"), rate)
    rejected = staged(verdicts.where("rejected").groupBy("host").agg(
        F.array_sort(F.collect_list("rule")).alias("by")), "quality-rejected")
    hosts = rejected.withColumnRenamed("host", "rejected_host")
    found = counted.join(hosts, counted["host"].eqNullSafe(hosts["rejected_host"]), "left")
    by = F.coalesce("by", F.array().cast("array<string>"))
    return found.select(
        "row", *COUNTS, base_failed().alias("base_failed"), by.alias("host_rejected_by"),
        (~base_failed() & (F.size(by) == 0)).alias("kept"))
