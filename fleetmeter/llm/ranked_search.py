"""Ranked lexical search of many items at once, with shared term sets evaluated once.

Items that have terms in common would add up the same products for the same documents
again and again. So pairs of terms, and pairs of pairs, that several items hold together
are mined first: each becomes a node of a graph whose inner nodes are shared sets and
whose sinks are the items. For a block of documents the terms' products are laid out once,
every node's partial sum is made once from its two parts, and an item adds up the few
nodes that make it whole.

Documents are read once for an index: of each, its length and how often each term of the
items stands in it; the tasks also count documents, lengths and documents for each term.
The index is written, and the search passes over it where it lies: what is shuffled is
ten rows for each item and task.

Items come in blocks of bounded size, each with a pass of its own, so neither the graph
nor the tables of terms grow beyond a block.

Defined cases: NULL and empty texts have no terms: such documents count for nothing, such
items find nothing; every row of `benchmark` is an item of its own and every row of
`documents` a document of its own, whatever their ids; documents without id come after
those with one where scores tie. A very long text is read slice by slice.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window

from fleetmeter.llm.batches import LOWER, WORD_BYTES, hashed_runs, text_chunks
from fleetmeter.sources.staging import staged

BEST = 10

#: Items, and different terms of items, in a block: the bound of what the driver and the tasks hold.
BLOCK_ITEMS = 4096
BLOCK_ENTRIES = 200_000

#: Symbols of an item, the most shared ones, among which pairs are mined in a round.
PAIR_SYMBOLS = 64
ROUNDS = 32

#: Numbers of the table of partial sums that a task holds.
CELLS = 1 << 22

# The score's scale and its length correction.
SCALE = 1_000_000_000
LENGTH_PERCENT = 75

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_weight(documents, holding):
    """A term's weight, from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def term_hashes(terms):
    """64-bit hashes as `hashed_runs` makes them."""
    found = np.zeros(len(terms), np.uint64)
    for i, term in enumerate(terms):
        data = term.encode()
        hashes, at, _ = hashed_runs(data, np.array([0, len(data)]), WORD_BYTES)
        found[i] = hashes[0]
    return found


class SharedSums:
    """Items as a graph of sums: leaves (term, times), then nodes (left, right), then the items' symbols."""

    def __init__(self, items):
        """`items` are dicts term -> times."""
        leaves = {}
        own = [np.array(sorted(leaves.setdefault(leaf, len(leaves)) for leaf in item.items()), np.int64) for item in items]
        self.leaf_terms = np.array([term for term, _ in leaves], np.int64)
        self.leaf_times = np.array([times for _, times in leaves], np.int64)
        self.levels, self.items = [], own
        self.symbols = len(leaves)
        for _ in range(ROUNDS):
            if not self._mine():
                break

    def _mine(self):
        """Turns the pairs that most items share, each symbol in one pair at most, into nodes."""
        usage = np.bincount(np.concatenate(self.items), minlength=self.symbols) if self.items else np.zeros(0, int)
        codes = []
        for item in self.items:
            shared = item[usage[item] > 1]
            if len(shared) > PAIR_SYMBOLS:
                shared = np.sort(shared[np.argsort(-usage[shared], kind="stable")[:PAIR_SYMBOLS]])
            a, b = np.triu_indices(len(shared), 1)
            codes.append(shared[a] * self.symbols + shared[b])
        pairs, counts = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, int),) * 2
        order = np.lexsort((pairs, -counts))
        partner, chosen = {}, []
        for at in order[counts[order] > 1]:
            left, right = divmod(int(pairs[at]), self.symbols)
            if left not in partner and right not in partner:
                node = self.symbols + len(chosen)
                partner[left], partner[right] = (right, node), (left, node)
                chosen.append((left, right))
        for i, item in enumerate(self.items):
            held, made = set(item.tolist()), set()
            for symbol in list(held):
                other, node = partner.get(symbol, (None, None))
                if other in held and symbol in held:
                    held -= {symbol, other}
                    made.add(node)
            self.items[i] = np.array(sorted(held | made), np.int64)
        if chosen:
            self.levels.append(np.array(chosen, np.int64).T)
            self.symbols += len(chosen)
        return bool(chosen)

    def sums(self, products):
        """Items x documents, from terms x documents; every node is made once."""
        table = np.empty((self.symbols, products.shape[1]), np.int64)
        at = len(self.leaf_terms)
        np.multiply(products[self.leaf_terms], self.leaf_times[:, None], out=table[:at])
        for left, right in self.levels:
            np.add(table[left], table[right], out=table[at:at + len(left)])
            at += len(left)
        return np.array([table[item].sum(axis=0) for item in self.items]).reshape(len(self.items), -1)


class Best:
    """The `count` highest-scoring documents of each item; ties by id, those without one last."""

    def __init__(self, items, count):
        self.count = count
        self.scores = np.zeros((items, count), np.int64)
        self.ids = np.zeros((items, count), np.int64)
        self.unnamed = np.ones((items, count), bool)

    def add(self, sums, ids, unnamed):
        """`sums` are items x documents; scores of 0 take no part."""
        last, last_id, last_unnamed = self.scores[:, -1:], self.ids[:, -1:], self.unnamed[:, -1:]
        before = (unnamed < last_unnamed) | ((unnamed == last_unnamed) & (ids < last_id))
        better = (sums > 0) & ((sums > last) | ((sums == last) & before))
        for item in np.flatnonzero(better.any(axis=1)):
            at = np.flatnonzero(better[item])
            scores = np.r_[self.scores[item], sums[item, at]]
            both, blank = np.r_[self.ids[item], ids[at]], np.r_[self.unnamed[item], unnamed[at]]
            order = np.lexsort((both, blank, -scores))[:self.count]
            self.scores[item], self.ids[item], self.unnamed[item] = scores[order], both[order], blank[order]

    def rows(self):
        item, place = np.nonzero(self.scores)
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(self.ids[item, place], mask=self.unnamed[item, place]),
             pa.array(self.scores[item, place])], names=["item", "doc_id", "score"])


def item_terms(benchmark, item_column="item_id", text_column="text"):
    """(item, item_id, words): each row of `benchmark`, numbered, with its terms as they stand."""
    words = F.regexp_extract_all(
        F.translate(F.coalesce(F.col(text_column), F.lit("")), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    return staged(benchmark.select(F.monotonically_increasing_id().alias("item"),
                                   F.col(item_column).alias("item_id"), words.alias("words")), "search-items")


def _indexed(hashes):
    """Documents -> (kind, id, n, terms, times). Kind 0: a document with terms of the items, their numbers and
    how often they stand in it. Kind 1, one a task: documents, their terms, and documents for each term."""
    def index(batches):
        order = np.argsort(hashes)
        known = hashes[order]
        documents, length = 0, 0
        holding = np.zeros(len(known), np.int64)

        def rows(kind, ids, ns, ends, terms, times):
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ns), kind), pa.int8()), ids, pa.array(ns, pa.int64()), *lists],
                names=["kind", "id", "n", "terms", "times"])

        for batch in batches:
            for first, starts, data in text_chunks(batch.column(1)):
                words, at, _ = hashed_runs(data.translate(LOWER), starts, WORD_BYTES)
                sizes = np.diff(at)
                documents += int((sizes > 0).sum())
                length += int(sizes.sum())
                place = np.searchsorted(known, words)
                place[place == len(known)] = 0
                hit = known[place] == words if len(known) else np.zeros(len(words), bool)
                text = np.repeat(np.arange(len(sizes)), sizes)[hit]
                keys, times = np.unique(text * len(known) + order[place[hit]], return_counts=True)
                text, term = np.divmod(keys, max(len(known), 1))
                holding += np.bincount(term, minlength=len(known))
                with_terms, counts = np.unique(text, return_counts=True)
                if len(with_terms):
                    yield rows(0, batch.column(0).slice(first, len(sizes)).take(pa.array(with_terms)), sizes[with_terms],
                               np.r_[0, np.cumsum(counts)], term, times)
        if documents:
            term = np.flatnonzero(holding)
            yield rows(1, pa.array([documents], pa.int64()), np.array([length]), np.array([0, len(term)]), term, holding[term])

    return index


def _searched(plan, weights, documents, length, count):
    """Index rows -> (item, doc_id, score): the best of each item among the task's documents."""

    def search(batches):
        sums = plan.value
        best = Best(len(sums.items), count)
        size = max(1, CELLS // (sums.symbols + len(weights)))
        for whole in batches:
            for begin in range(0, whole.num_rows, size):
                batch = whole.slice(begin, size)
                ids, terms, times = batch.column(0), batch.column(2), batch.column(3)
                counts = np.diff(terms.offsets.to_numpy())
                doc = np.repeat(np.arange(batch.num_rows), counts)
                n = batch.column(1).to_numpy()
                m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // length
                tf = times.flatten().to_numpy().astype(np.int64)
                term = terms.flatten().to_numpy()
                products = np.zeros((len(weights), batch.num_rows), np.int64)
                products[term, doc] = weights[term] * (SCALE * tf // (1000 * tf + 8 * m[doc]))
                best.add(sums.sums(products), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield best.rows()

    return search


def _first(rows, group, count):
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= count)


def _block_results(docs, items, count):
    """(item, doc_id, score) of the items of one block: the best of every task."""
    spark = docs.sparkSession
    terms, wanted = {}, {}
    for row in items.toLocalIterator():
        own = wanted.setdefault(row["item"], {})
        for word in row["words"]:
            number = terms.setdefault(word, len(terms))
            own[number] = own.get(number, 0) + 1
    numbers = sorted(wanted)
    schema = "kind tinyint, id bigint, n bigint, terms array<int>, times array<int>"
    index = staged(docs.mapInArrow(_indexed(term_hashes(list(terms))), schema), "search-index", by=["kind"])
    sizes = index.where("kind = 1")
    totals = sizes.agg(F.sum("id"), F.sum("n")).first()
    documents, length = int(totals[0] or 0), int(totals[1] or 1)
    holding = np.zeros(len(terms), np.int64)
    each = sizes.select(F.explode(F.arrays_zip("terms", "times")).alias("of")).groupBy("of.terms").agg(F.sum("of.times"))
    for term, held in each.collect():
        holding[term] = held
    weights = np.array([term_weight(documents, int(held)) for held in holding], np.int64)
    plan = spark.sparkContext.broadcast(SharedSums([wanted[i] for i in numbers]))
    places = spark.createDataFrame(list(enumerate(numbers)), "place bigint, number bigint")
    found = index.where("kind = 0").select("id", "n", "terms", "times").mapInArrow(
        _searched(plan, weights, documents, length, count), "item bigint, doc_id bigint, score bigint")
    # One row for each item of the block.
    found = found.join(F.broadcast(places), found["item"] == places["place"])
    return found.select(F.col("number").alias("item"), "doc_id", "score", F.spark_partition_id().alias("task"))


#: Tasks whose results of an item are ranked together before the last ranking.
TASKS_TOGETHER = 256


def ranked(docs, benchmark, id_column="doc_id", text_column="text", item_column="item_id", count=BEST,
           block_items=BLOCK_ITEMS, block_entries=BLOCK_ENTRIES):
    """(item, item_id, rank, doc_id, score): each item's highest-scoring documents."""
    items = item_terms(benchmark, item_column, "text")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.expr(f"cast(`{text_column}` as binary)").alias("text_utf8"))
    number, entries = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    blocks = max(1, -(-number // block_items), -(-entries // block_entries))
    found = None
    for block in range(blocks):
        in_block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        own = _block_results(rows, in_block, count)
        if blocks > 1:
            own = staged(own, "search-found")
        found = own if found is None else found.unionByName(own)
    together = found.withColumn("task", F.floor(F.col("task") / TASKS_TOGETHER))
    best = _first(_first(together, ["item", "task"], count).drop("rank"), ["item"], count)
    return best.join(items.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")
