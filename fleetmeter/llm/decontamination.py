"""Benchmark decontamination by one Aho-Corasick automaton.

A window is ten consecutive words of a benchmark item, or the whole item if it has
fewer. The automaton holds every window, as a run of word numbers, so its states are words
and not letters; a text is scanned once, word by word in normal form, and hits are carried
back to the characters of the original.

Defined cases: NULL and empty texts have no words and no hits; an item without
words has no windows; windows of an item without id hit words, but no item is counted for
them; a benchmark without windows hits nothing; repeated documents and items are treated
row by row, and item ids count once per document; empty tables give no rows. A very long
text takes about fifty bytes for each of its words while it is scanned. Rows keep their own
columns: the operator reads the two columns it is told and adds none of the others.
"""

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.llm.batches import LOWER, WORD_BYTES, field_place, row_slices, text_chunks
from fleetmeter.sources.staging import staged

WINDOW_WORDS = 10
#: Windows in one automaton, about 800 bytes each in a worker. A larger benchmark is
#: cut into blocks, and the texts pass one automaton after another.
BLOCK_WINDOWS = 500_000

_NORMAL = bytes(b if WORD_BYTES[b] else 32 for b in LOWER)

SPANS = T.ArrayType(T.StructType([
    T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
]))


def normal_words(text):
    """Words of UTF-8 bytes after lower-casing A-Z."""
    return text.translate(_NORMAL).split()


def benchmark_windows(benchmark, item_column="item_id", text_column="text", size=WINDOW_WORDS):
    """One row for each distinct window and item that has it: (window, item)."""
    words = F.expr(
        f"regexp_extract_all(translate({text_column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz'), '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', 0)"
    )
    listed = benchmark.select(F.col(item_column).cast("string").alias("item"), words.alias("words"))
    listed = listed.where("size(words) > 0")
    windows = F.expr(
        f"transform(sequence(1, greatest(1, size(words) - {size - 1})), "
        f"i -> array_join(slice(words, i, {size}), ' '))"
    )
    return listed.select("item", F.explode(windows).alias("window")).distinct()


class Windows:
    """An automaton over the numbers of the words that windows have; other words are 0."""

    def __init__(self, windows):
        """`windows` are words joined by spaces -> ids of the items that have them."""
        self.numbers = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows.items():
            key = tuple(self.numbers.setdefault(word, len(self.numbers) + 1) for word in window.encode().split(b" "))
            self.automaton.add_word(key, (len(key), tuple(items)))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text):
        """(number of words, hit word spans merged, items) of one text."""
        words = normal_words(text)
        if not words or not len(self.automaton):
            return len(words), [], set()
        number = self.numbers.get
        spans, items = [], set()
        for end, (length, owners) in self.automaton.iter(tuple([number(word, 0) for word in words])):
            first, last = end + 1 - length, end + 1
            items.update(owners)
            if spans and first <= spans[-1][1] and first >= spans[-1][0]:
                spans[-1][1] = max(spans[-1][1], last)
            else:
                spans.append([first, last])
        return len(words), merged(spans), items


_built = {}


def _automaton(shared):
    """The automaton of a block's windows, built once in each process."""
    if shared not in _built:
        _built.clear()
        _built[shared] = Windows(shared.value)
    return _built[shared]


def merged(spans):
    """Spans that overlap or touch as one, in order."""
    out = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _block_scanner(windows, place):
    """Adds what one block of windows hits to the columns n_words, hit_words, items.

    The text is field number `place` of the first column, `row`.
    """

    def scan(batches):
        automaton = _automaton(windows)
        for piece, texts in (found for batch in batches for found in row_slices(batch, place)):
            names = piece.schema.names
            old_spans = piece.column(names.index("hit_words")).to_pylist()
            old_items = piece.column(names.index("hit_items")).to_pylist()
            counts, spans, items = [], [], []
            for first, starts, data in text_chunks(texts):
                for row in range(len(starts) - 1):
                    count, hit, owners = automaton.scan(data[starts[row]:starts[row + 1]])
                    before = [[s["first_word"], s["end_word"]] for s in old_spans[first + row]]
                    counts.append(count)
                    spans.append([
                        {"first_word": a, "end_word": b} for a, b in merged(before + hit)
                    ])
                    items.append(sorted(owners.union(old_items[first + row])))
            columns = {name: piece.column(i) for i, name in enumerate(names)}
            columns["n_words"] = pa.array(counts, pa.int64())
            columns["hit_words"] = pa.array(spans, piece.schema.field("hit_words").type)
            columns["hit_items"] = pa.array(items, piece.schema.field("hit_items").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=piece.schema)

    return scan


def decontaminated(docs, benchmark, id_column="doc_id", text_column="text", item_column="item_id",
                   size=WINDOW_WORDS, block_windows=BLOCK_WINDOWS):
    """(row, n_words, hit_words, hit_items) for every row of `docs`.

    `row` holds the columns of `docs`; `hit_words` are merged spans of word numbers
    from 0, end exclusive; `hit_items` the ids of the items hit, as strings, sorted.
    Windows travel to the tasks as broadcasts of at most `block_windows` windows. A
    larger benchmark takes one pass for each block, written between passes so that
    a task holds a single automaton at a time.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_column, "text", size)
    blocks = -(-windows.count() // block_windows) or 1
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("hit_words"),
        F.array().cast("array<string>").alias("hit_items"),
    )
    place = field_place(docs, text_column)
    for block in range(blocks):
        in_block = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        owned = {}
        for row in in_block.toLocalIterator():
            own = owned.setdefault(row["window"], [])
            if row["item"] is not None:
                own.append(row["item"])
        rows = rows.mapInArrow(_block_scanner(spark.sparkContext.broadcast(owned), place), rows.schema)
        if block < blocks - 1:
            rows = staged(rows, "decontamination")
    return rows


_WORD = None


def character_spans(text, spans):
    """Character offsets in the original text of spans of word numbers."""
    global _WORD
    if _WORD is None:
        import re
        _WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    bounds = [m.span() for m in _WORD.finditer(text or "")]
    return [(bounds[a][0], bounds[b - 1][1]) for a, b in spans]


def without_hits(found, text_column="text"):
    """Rows of `decontaminated` as documents again, the hit passages cut out of the text."""

    def cut(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            spans = batch.column(1).to_pylist()
            clean = []
            for text, hits in zip(texts, spans):
                if hits:
                    kept, at = [], 0
                    for a, b in character_spans(text, [(h["first_word"], h["end_word"]) for h in hits]):
                        kept.append(text[at:a])
                        at = b
                    text = "".join([*kept, text[at:]])
                clean.append(text)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()), *rest],
                                             names=["clean", *batch.schema.names[2:]])

    row = found.schema["row"].dataType
    shaped = found.select(F.col(f"row.`{text_column}`").alias("clean"), "hit_words", "row")
    schema = T.StructType([T.StructField("clean", T.StringType()), T.StructField("row", row)])
    cleaned = shaped.mapInArrow(cut, schema)
    return cleaned.select(*[
        F.col("clean").alias(name) if name == text_column else F.col(f"row.`{name}`").alias(name)
        for name in row.names
    ])
