"""Texts of an Arrow batch as one byte array, words found and hashed in numpy.

Tasks hand texts over as UTF-8 bytes. A batch is cut into chunks of bounded size,
never inside a text, so that numpy's scratch arrays stay small whatever the batch.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[ord("0"):ord("9") + 1] = True
WORD_BYTES[ord("a"):ord("z") + 1] = True
WORD_BYTES[128:] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
SOLID_BYTES = np.ones(256, bool)
SOLID_BYTES[[0x20, *range(0x09, 0x0E)]] = False

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values):
    """A one-to-one scramble of 64-bit values."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIXERS[0]
    x = (x ^ (x >> np.uint64(27))) * _MIXERS[1]
    return x ^ (x >> np.uint64(31))


def _stretches(offsets, limit):
    """(first, last) of consecutive texts of `limit` bytes in all, or one longer text."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def text_chunks(column, limit=CHUNK_BYTES):
    """Yields (first row, starts, bytes): texts of a binary column; NULL is empty.

    `starts` has one more entry than the chunk has texts. A text longer than the
    limit is a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"").cast(pa.large_binary())
    count = len(column)
    if not count:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + count + 1]
    data = data_buffer if data_buffer is not None else pa.py_buffer(b"")
    for first, last in _stretches(offsets, limit):
        piece = data.slice(offsets[first], offsets[last] - offsets[first]).to_pybytes()
        yield first, offsets[first:last + 1] - offsets[first], piece


def row_slices(batch, place, limit=CHUNK_BYTES):
    """Yields (slice of the batch, its texts as bytes): rows whose texts take `limit` bytes, or one row.

    The first column is a struct, whose field number `place` is the text: it need not be
    sent a second time. What a task makes of its rows and hands back at once so follows
    the bytes of a slice and not those of all rows that Spark puts into a batch.
    """
    texts = batch.column(0).field(place).cast(pa.large_binary())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for first, last in _stretches(np.concatenate([[0], np.cumsum(lengths)]), limit):
        yield batch.slice(first, last - first), texts.slice(first, last - first)


def field_place(df, name):
    """Number of the column `name` among those of `df`; as in Spark, case may differ."""
    names = df.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def word_bounds(data, starts, table):
    """Starts and ends of the words, and for each text the number of words before it."""
    inside = table[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[starts[:-1][starts[:-1] < len(data)]] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    tails = starts[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, starts)


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(length):
    global _powers, _inverses
    if len(_powers) <= length:
        size = max(length + 1, 2 * len(_powers), CHUNK_BYTES + 1)
        inverse = pow(int(_FACTOR), -1, 1 << 64)
        powers = np.full(size, _FACTOR, np.uint64)
        inverses = np.full(size, np.uint64(inverse), np.uint64)
        powers[0] = inverses[0] = 1
        _powers = np.multiply.accumulate(powers)
        _inverses = np.multiply.accumulate(inverses)


def word_hashes(data, begins, ends):
    """64-bit hashes of the words, alike in every process."""
    _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * _inverses[begins])


def binary_text(column="text"):
    """SQL of a text column as UTF-8 bytes, which tasks read without decoding."""
    return f"cast({column} as binary)"


def _run_beyond(data, begin, table):
    """End of the run of `table` bytes that starts at `begin`, read a slice at a time."""
    at = begin
    while at < len(data):
        other = np.flatnonzero(~table[np.frombuffer(data, np.uint8, min(CHUNK_BYTES, len(data) - at), at)])
        if len(other):
            return at + int(other[0])
        at += CHUNK_BYTES
    return len(data)


def slices(data, table):
    """Cuts one long text between runs of `table` bytes: yields (begin, end, whole).

    Slices are of CHUNK_BYTES at most; `whole` marks a single run longer than that,
    which is a slice of its own.
    """
    begin = 0
    while begin < len(data):
        size = min(CHUNK_BYTES, len(data) - begin)
        if begin + size == len(data):
            yield begin, len(data), False
            return
        other = np.flatnonzero(~table[np.frombuffer(data, np.uint8, size, begin)])
        if len(other):
            yield begin, begin + int(other[-1]) + 1, False
            begin += int(other[-1]) + 1
        else:
            end = _run_beyond(data, begin, table)
            yield begin, end, True
            begin = end


def hashed_runs(data, starts, table, holding=None):
    """Hashes of the runs of `table` bytes in a chunk, the number of runs before each text,
    and, with `holding`, whether a run has a byte of that table.

    A chunk longer than CHUNK_BYTES is one text; it is taken slice by slice, so scratch
    arrays stay small and what remains is one hash for each run.
    """
    if len(data) <= CHUNK_BYTES:
        array = np.frombuffer(data, np.uint8)
        begins, ends, at = word_bounds(array, starts, table)
        holds = None
        if holding is not None:
            sums = np.zeros(len(array) + 1, np.int64)
            np.cumsum(holding[array], out=sums[1:])
            holds = sums[ends] > sums[begins]
        return word_hashes(array, begins, ends), at, holds
    hashes, holds = [], []
    for begin, end, whole in slices(data, table):
        if whole:
            digest = hashlib.blake2b(memoryview(data)[begin:end], digest_size=8).digest()
            hashes.append(np.frombuffer(digest, np.uint64))
            if holding is not None:
                holds.append(np.array([any(
                    holding[np.frombuffer(data, np.uint8, min(CHUNK_BYTES, end - i), i)].any()
                    for i in range(begin, end, CHUNK_BYTES))]))
        else:
            own, _, held = hashed_runs(data[begin:end], np.array([0, end - begin]), table, holding)
            hashes.append(own)
            holds.append(held)
    joined = np.concatenate(hashes)
    return joined, np.array([0, len(joined)]), np.concatenate(holds) if holding is not None else None
