"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds its distinct shingles of five words. Sets are taken in bands
of size. Inside a band two sets of similarity 0.8 or more differ in at most k
shingles, a number that follows from the band alone. A hash cuts the shingles'
domain into k + 1 + s parts (here the first level of PartEnum; its second-level
subsets are single parts). At most k parts can differ, so such sets agree in s + 1
parts or more: the shingles of a part, as one hash, are a signature, and similar sets
share s + 1 of them. A set meets the sets of the next band by signatures of that band.

Parts may be empty, and empty parts say nothing. The s spare parts pay for them: a
set with at most s empty parts shares a signature that is not empty. A set with more
adds its prefix, the shingles of least hash of which similar sets always share one,
each as a signature.

Copies are one node: the hash of the set. A signature of up to SMALL nodes gives all
its pairs. A node with no more signatures of larger groups than it has spare parts
shares a rarer signature with each of its partners; the other nodes are signed again, at a
second level, by classes of size a tenth wide. There a set is signed once for each class
that its smaller partners may lie in, by those of its shingles, the rarest first, of which
two sets of these sizes must share one. The closer the sizes, the fewer these are: sets
that have a frequent passage in common meet there only where almost all the rest is
frequent too. Such sets are mostly near copies of each other. So each is held against a few
of its group first, and only where a group then still lies in several components do its
members meet each other: those of different components whose sizes, places of the
signature in their order, and bitmaps of 256 bits leave room for a similarity of 0.8.
Pairs are verified on the sets.

Defined cases: NULL and empty texts and texts without words have an empty set and are
linked with nothing; rows that share an id are one document with all their links;
rows without an id get their set size and no component. An empty table gives no rows. A
text longer than a chunk is hashed slice by slice; what is held of it is its words' hashes,
a few times eight bytes each. Columns other than the two named are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.llm.batches import SOLID_BYTES, LOWER, hashed_runs, mixed, text_chunks
from fleetmeter.llm.components import connected, merged
from fleetmeter.sources.staging import staged

SHINGLE_WORDS = 5
#: Similarity as a fraction, so that the test is exact.
SIMILAR, WHOLE = 80, 100
SMALL = 8
#: Rounds in which every node of a large group is held against a few of them, and how few.
PIVOT_ROUNDS = 1
PIVOTS = 3

_TERMS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93,
                   0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_sets(data, starts):
    """Sorted distinct shingle hashes of each text of a chunk."""
    hashes, at, _ = hashed_runs(data.translate(LOWER), starts, SOLID_BYTES)
    count = len(hashes)
    sums = np.zeros(count, np.uint64)
    # A chunk may hold fewer words than a shingle.
    for i, term in enumerate(_TERMS[:count]):
        sums[:count - i] += mixed(hashes[i:] * term + np.uint64(i))
    sums = mixed(sums)
    sets = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE_WORDS:
            sets.append(np.unique(sums[a:b - SHINGLE_WORDS + 1]))
        elif b > a:
            terms = _TERMS[:b - a]
            whole = mixed(hashes[a:b] * terms + np.arange(b - a, dtype=np.uint64)).sum(dtype=np.uint64)
            sets.append(mixed(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_hash(own):
    """The node of a set: one value for equal sets."""
    total = mixed(own + np.uint64(len(own))).sum(dtype=np.uint64)
    return mixed(np.array([total ^ np.uint64(len(own) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64)).astype(np.int64)[0]


def bands():
    """Largest sizes of the bands: each holds sizes up to 25/16 of the one before."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * WHOLE * WHOLE // (SIMILAR * SIMILAR)))
    return np.array(ends)


_BANDS = bands()


def parts_of(band):
    """(parts, spare parts) of a band."""
    differ = 2 * int(_BANDS[band]) * (WHOLE - SIMILAR) // (WHOLE + SIMILAR)
    spare = 1 + differ // 4
    return differ + 1 + spare, spare


def band_numbers(size):
    """The band of a size, and the next one where a similar set can be larger than the band."""
    own = int(np.searchsorted(_BANDS, size))
    return [own, own + 1] if size * WHOLE // SIMILAR > _BANDS[own] else [own]


def _places(own, band, parts):
    """The part of each shingle."""
    seed = np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    place = ((mixed(own ^ seed) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return place.astype(np.int64), seed


def prefix_size(count):
    """Similar sets share one of so many shingles of each, in any common order."""
    return count - -(-count * SIMILAR // WHOLE) + 1


def spare_parts(own):
    """Spare parts of a set that its empty parts leave over."""
    left = 1 << 30
    for band in band_numbers(len(own)):
        parts, spare = parts_of(band)
        empty = parts - np.count_nonzero(np.bincount(_places(own, band, parts)[0], minlength=parts))
        left = min(left, max(0, spare - empty))
    return left


def signatures(own):
    found = []
    for band in band_numbers(len(own)):
        parts, spare = parts_of(band)
        place, seed = _places(own, band, parts)
        order = np.argsort(place, kind="stable")
        place, members = place[order], mixed(own[order] + seed)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sums = np.add.reduceat(members, first)
        found.append(mixed(sums + place[first].astype(np.uint64) * _TERMS[0] + seed))
        if parts - len(first) > spare:
            # Sets like this one share one of the shingles of least hash.
            found.append(mixed(own[:prefix_size(len(own))] ^ _TERMS[1]))
    return np.unique(np.concatenate(found))


def _utf8(docs, id_column, text_column):
    return docs.select(F.col(id_column).cast("long").alias("id"),
                       F.expr(f"cast({text_column} as binary)").alias("text_utf8"))


def digests(docs, id_column="doc_id", text_column="text"):
    """(id, size, node, spare) of every row."""

    def digest(batches):
        for batch in batches:
            sizes, nodes, spares = [], [], []
            for _, starts, data in text_chunks(batch.column(1)):
                for own in shingle_sets(data, starts):
                    sizes.append(len(own))
                    nodes.append(set_hash(own) if len(own) else None)
                    spares.append(spare_parts(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(spares, pa.int64())], names=["id", "size", "node", "spare"])

    return _utf8(docs, id_column, text_column).mapInArrow(
        digest, "id bigint, size bigint, node bigint, spare bigint")


#: Nodes a task remembers so that copies it meets send their signatures once.
_REMEMBERED = 100_000


def node_signatures(docs, id_column="doc_id", text_column="text"):
    """(signature, node); copies inside a task once."""

    def sign(batches):
        seen = set()
        for batch in batches:
            for _, starts, data in text_chunks(batch.column(1)):
                all_signs, all_nodes = [], []
                for own in shingle_sets(data, starts):
                    if not len(own):
                        continue
                    node = set_hash(own)
                    if node in seen:
                        continue
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    signs = signatures(own)
                    all_signs.append(signs)
                    all_nodes.append(np.full(len(signs), node))
                if all_signs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(all_signs).astype(np.int64)),
                         pa.array(np.concatenate(all_nodes).astype(np.int64))],
                        names=["signature", "node"])

    rows = _utf8(docs, id_column, text_column).where("id IS NOT NULL")
    return rows.mapInArrow(sign, "signature bigint, node bigint")


def _groups(batches):
    """Pairs of the nodes of each signature; rows come sorted by signature and node.

    Up to SMALL nodes: every pair, with no signature. More: each node with the first,
    under the signature. At most SMALL + 1 rows of a signature are in memory beside
    the batch.
    """
    carried_sign, carried, pivot = None, np.zeros(0, np.int64), None

    def emit(sign, nodes, first):
        if first is not None:
            return [(np.full(len(nodes), first), nodes, np.full(len(nodes), sign), True)]
        if len(nodes) > SMALL:
            return [(np.full(len(nodes) - 1, nodes[0]), nodes[1:], np.full(len(nodes) - 1, sign), True)]
        a, b = np.triu_indices(len(nodes), 1)
        return [(nodes[a], nodes[b], np.full(len(a), sign), False)] if len(a) else []

    def table(pieces):
        lower = np.concatenate([p[0] for p in pieces])
        upper = np.concatenate([p[1] for p in pieces])
        hot = np.concatenate([np.full(len(p[0]), p[3]) for p in pieces])
        signs = np.concatenate([p[2] for p in pieces])
        small = ~hot
        parts = [(lower[hot], upper[hot], signs[hot], np.ones(hot.sum(), np.int64))]
        if small.any():
            # Two nodes meet in many small groups: each batch sends them once, with the number.
            low, up = lower[small], upper[small]
            order = np.lexsort((up, low))
            low, up = low[order], up[order]
            begin = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (up[1:] != up[:-1])])
            parts.append((low[begin], up[begin], np.zeros(len(begin), np.int64), np.diff(np.r_[begin, len(low)])))
        lower, upper, signs, shared = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays(
            [pa.array(lower), pa.array(upper), pa.array(signs, mask=np.arange(len(signs)) >= hot.sum()), pa.array(shared)],
            names=["lower", "upper", "signature", "shared"])

    for batch in batches:
        sign = batch.column(0).to_numpy()
        node = batch.column(1).to_numpy()
        fresh = np.r_[True, (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])]
        sign, node = sign[fresh], node[fresh]
        first = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
        last = np.r_[first[1:], len(sign)]
        pieces = []
        # Groups inside the batch, all but the last, in bulk by size.
        inner = slice(1 if carried_sign is not None and len(sign) and sign[0] == carried_sign else 0, len(first) - 1)
        if inner.start == 0 and carried_sign is not None:
            pieces += emit(carried_sign, carried, pivot) if pivot is None else []
            carried_sign, carried, pivot = None, np.zeros(0, np.int64), None
        elif inner.start == 1:
            more = node[first[0]:last[0]]
            more = more[more != (carried[-1] if len(carried) else pivot)]
            if pivot is not None:
                pieces += emit(carried_sign, more, pivot)
            else:
                carried = np.r_[carried, more]
                if len(carried) > SMALL:
                    pieces += emit(carried_sign, carried, None)
                    pivot, carried = carried[0], carried[-1:]
            if len(first) > 1:
                if pivot is None:
                    pieces += emit(carried_sign, carried, None)
                carried_sign, carried, pivot = None, np.zeros(0, np.int64), None
            elif pivot is not None and len(more):
                carried = more[-1:]
        begins, sizes = first[inner], (last - first)[inner]
        for size in np.unique(sizes[sizes > 1]):
            chosen = begins[sizes == size]
            if size <= SMALL:
                grid = node[chosen[:, None] + np.arange(size)]
                a, b = np.triu_indices(size, 1)
                pieces.append((grid[:, a].ravel(), grid[:, b].ravel(), np.repeat(sign[chosen], len(a)), False))
            else:
                for at in chosen:
                    pieces += emit(sign[at], node[at:at + size], None)
        if len(first) > 1 or (len(first) == 1 and carried_sign is None):
            carried_sign, carried, pivot = sign[first[-1]], node[first[-1]:], None
            if len(carried) > SMALL:
                pieces += emit(carried_sign, carried, None)
                pivot, carried = carried[0], carried[-1:]
        if pieces:
            yield table(pieces)
    if carried_sign is not None and pivot is None:
        pieces = emit(carried_sign, carried, None)
        if pieces:
            yield table(pieces)


def candidate_pairs(signed):
    """(lower, upper, signature, shared): signature NULL where groups were small, `shared` of them."""
    dealt = signed.repartition("signature").sortWithinPartitions("signature", "node")
    return dealt.mapInArrow(_groups, "lower bigint, upper bigint, signature bigint, shared bigint")


#: Bits of the bitmap for each key, and in all: the bound of what is broadcast.
KEY_BITS, MOST_BITS = 16, 1 << 27
_CHUNK = 1 << 16


def _key_places(keys, bits):
    """Two places of each key in a bitmap."""
    first = mixed(keys ^ _TERMS[2])
    return [(first & np.uint64(bits - 1)).astype(np.int64), (mixed(first) & np.uint64(bits - 1)).astype(np.int64)]


def wanted_bitmap(wanted):
    """A bitmap that has every id of `wanted`, and by chance a few more.

    Tasks fill chunks of it, which are joined before they reach the driver: what arrives
    there has a fixed bound, whatever the number of keys. Beyond it, more pass by chance.
    """
    bits = 1 << max(13, min(MOST_BITS, wanted.count() * KEY_BITS).bit_length())

    def fill(batches):
        own = np.zeros(bits, bool)
        for batch in batches:
            for places in _key_places(batch.column(0).to_numpy().astype(np.uint64), bits):
                own[places] = True
        packed = np.packbits(own)
        chunks = [(i, packed[i * _CHUNK:(i + 1) * _CHUNK].tobytes()) for i in range(-(-len(packed) // _CHUNK))]
        chunks = [c for c in chunks if c[1].strip(b"\0")]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunks], pa.int32()),
                                          pa.array([c[1] for c in chunks], pa.binary())], names=["chunk", "bits"])

    def join(batches):
        held = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(data, np.uint8)
                held[chunk] = own | held[chunk] if chunk in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                          pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["chunk", "bits"])

    schema = "chunk int, bits binary"
    packed = np.zeros(bits // 8, np.uint8)
    for chunk, data in wanted.mapInArrow(fill, schema).repartition("chunk").mapInArrow(join, schema).toLocalIterator():
        packed[chunk * _CHUNK:chunk * _CHUNK + len(data)] = np.frombuffer(data, np.uint8)
    return packed


def node_sets(docs, wanted, id_column="doc_id", text_column="text"):
    """(node, size, members, sketch) of the documents in `wanted` (id), and by chance of a few more.

    `members` are sorted 64-bit values; `sketch` is 16 bits of each. Texts stay where they
    are: a bitmap says which ones are asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(wanted))

    def take(batches):
        packed, seen = shared.value, set()
        for batch in batches:
            asked = np.ones(batch.num_rows, bool)
            for places in _key_places(batch.column(0).to_numpy().astype(np.uint64), len(packed) * 8):
                asked &= (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
            nodes, sizes, members, sketches = [], [], [], []
            for _, starts, data in text_chunks(batch.column(1).filter(pa.array(asked))):
                for own in shingle_sets(data, starts):
                    node = int(set_hash(own)) if len(own) else None
                    if node is None or node in seen:
                        continue
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(own))
                    members.append(own.tobytes())
                    sketches.append((own >> np.uint64(20)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary()),
                 pa.array(sketches, pa.binary())], names=["node", "size", "members", "sketch"])

    rows = _utf8(docs, id_column, text_column).where("id IS NOT NULL")
    sets = rows.mapInArrow(take, "node bigint, size bigint, members binary, sketch binary")
    return sets.dropDuplicates(["node"])


def _shared_members(a, b):
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _most_shared(a, b):
    """What two sets share at most, by their sketches: equal shingles have equal bits."""
    seen = np.zeros(1 << 16, bool)
    seen[np.frombuffer(b, np.uint16)] = True
    return int(seen[np.frombuffer(a, np.uint16)].sum())


def _keeps(count):
    """Passes on the pairs of which `count` says that they share enough."""

    def keep(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            shared = np.array([
                count(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column(4), batch.column(5))], np.int64)
            linked = pa.array(WHOLE * shared >= SIMILAR * (sizes - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(linked), batch.column(1).filter(linked)], names=["lower", "upper"])

    return keep


#: Pairs up to which their nodes are broadcast to the sets: two long values each.
FEW_PAIRS = 100_000


def _compared(pairs, sets, column, count):
    """Pairs of sizes that can be similar, held against each other by `column` of their sets."""
    if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
        # The sets of other nodes are not shuffled.
        nodes = pairs.select(F.explode(F.array("lower", "upper")).alias("node")).distinct()
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    sizes = sets.select("node", "size")
    rows = pairs.select("lower", "upper").join(sizes.toDF("lower", "lower_size"), "lower").join(
        sizes.toDF("upper", "upper_size"), "upper")
    rows = rows.where(F.least("lower_size", "upper_size") * WHOLE >= F.greatest("lower_size", "upper_size") * SIMILAR)
    held = sets.select("node", column)
    both = rows.join(held.toDF("lower", "lower_held"), "lower").join(held.toDF("upper", "upper_held"), "upper")
    return both.select("lower", "upper", "lower_size", "upper_size", "lower_held", "upper_held").mapInArrow(
        _keeps(count), "lower bigint, upper bigint")


def verified(pairs, sets):
    """The pairs whose sets are similar; `pairs` and `sets` are written tables.

    Sketches, a quarter of the size, rule most pairs out; the others are compared in full.
    """
    likely = staged(_compared(pairs, sets, "sketch", _most_shared), "join-likely")
    return _compared(likely, sets, "members", _shared_members)


def _ordered(a, b):
    return F.least(a, b).alias("lower"), F.greatest(a, b).alias("upper")


#: Counters of shingles, by hash: the bound of what says which are rare.
MOST_COUNTERS = 1 << 22


def _classes():
    """Least sizes of the classes of the second level: each a tenth above the one before."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, starts[-1] * 11 // 10))
    return np.array(starts)


_CLASSES = _classes()


def class_prefixes(count):
    """(class, length): two sets of similarity 0.8 or more, the smaller of the class and the larger of `count`,
    or both of one class, share one of so many shingles of each in any common order."""
    least = -(-count * SIMILAR // WHOLE)
    first, own = (int(np.searchsorted(_CLASSES, size, "right")) - 1 for size in (least, count))
    for number in range(first, own + 1):
        smallest = max(int(_CLASSES[number]), least)
        yield number, count - -(-SIMILAR * (count + smallest) // (WHOLE + SIMILAR)) + 1


def _rarity(sets):
    """How often shingles stand in the sets, by hashed counters: logarithms, in a table of bounded size."""
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    counters = min(MOST_COUNTERS, 1 << max(10, (4 * total).bit_length()))

    def count(batches):
        own = np.zeros(counters, np.int32)
        for batch in batches:
            for members in batch.column(0):
                np.add.at(own, _counter_of(np.frombuffer(members.as_buffer(), np.uint64), counters), 1)
        at = np.flatnonzero(own)
        for begin in range(0, len(at), 100_000):
            some = at[begin:begin + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].astype(np.int64))], names=["counter", "sets"])

    counted = sets.select("members").mapInArrow(count, "counter bigint, sets bigint").groupBy("counter").agg(
        F.floor(4 * F.log2(F.sum("sets"))).cast("int").alias("level")).where("level > 0")
    levels = np.zeros(counters, np.uint8)
    found = counted.toArrow()
    levels[found["counter"].to_numpy()] = np.minimum(found["level"].to_numpy(), 255)
    return levels


def _counter_of(own, counters):
    return (mixed(own ^ _TERMS[2]) & np.uint64(counters - 1)).astype(np.int64)


#: Words of 64 bits in a set's bitmap.
BITMAP = [f"bits_{i}" for i in range(4)]


def parity_bitmap(own):
    """256 bits, each the parity of the shingles that fall on it: two sets differ in as many shingles
    as their bitmaps in bits, or more."""
    places = (mixed(own ^ _TERMS[4]) >> np.uint64(56)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=256).astype(np.uint8) & 1).view(np.int64)


def _differing(a, b):
    """Bits that differ between two bitmaps, given as functions of a column's name."""
    return sum(F.bit_count(a(name).bitwiseXOR(b(name))) for name in BITMAP)


def _room(a_size, b_size, differing):
    """Whether sets that differ in so many shingles or more can be similar."""
    return (a_size + b_size - differing) * (WHOLE + SIMILAR) >= (a_size + b_size) * (2 * SIMILAR)


def class_signatures(sets):
    """(signature, node, size, place, own, *BITMAP): each set under the shingles it must share with a partner, by the
    class of the smaller of the two. `place` is the shingle's in the set's order, rarest first; `own` says
    that it is the set's own class. Two sets that are not `own` there are compared in another class."""
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def sign(batches):
        levels = shared.value
        for batch in batches:
            found = []
            for node, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(members.as_buffer(), np.uint64)
                bits = parity_bitmap(own)
                own = own[np.argsort(levels[_counter_of(own, len(levels))], kind="stable")]
                prefixes = list(class_prefixes(len(own)))
                for number, length in prefixes:
                    found.append((mixed(mixed(own[:length] ^ _TERMS[3]) + np.uint64(number)), node, len(own),
                                  number == prefixes[-1][0], bits))
            if found:
                lengths = [len(f[0]) for f in found]
                columns = [np.concatenate([f[0] for f in found]).astype(np.int64),
                           *[np.repeat([f[i] for f in found], lengths) for i in (1, 2)],
                           np.concatenate([np.arange(n) for n in lengths]), np.repeat([f[3] for f in found], lengths),
                           *np.repeat([f[4] for f in found], lengths, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns],
                                                 names=["signature", "node", "size", "place", "own", *BITMAP])

    return sets.select("node", "members").mapInArrow(
        sign, "signature bigint, node bigint, size bigint, place bigint, own boolean, "
        + ", ".join(f"{name} bigint" for name in BITMAP))


def _near_enough(a_size, b_size):
    return F.greatest(a_size, b_size) * SIMILAR <= F.least(a_size, b_size) * WHOLE


def pivot_pairs(members, number):
    """Each node of a large group with a few of them, alike for all groups of the same nodes."""
    def least(turn):
        return F.min(F.when(F.col("own"), F.struct(F.xxhash64("node", F.lit(turn)).alias("turn"), F.col("node").alias("pivot"),
                                                   F.col("size").alias("pivot_size"), *BITMAP)))

    groups = members.groupBy("signature").agg(
        F.count("*").alias("met"), F.array(*[least(number * PIVOTS + i) for i in range(PIVOTS)]).alias("pivots"))
    tried = members.join(groups.where(F.col("met") > SMALL), "signature").select(
        "node", "size", *BITMAP, F.explode("pivots").alias("of"))
    differing = _differing(F.col, lambda name: F.col(f"of.{name}"))
    tried = tried.where((F.col("node") != F.col("of.pivot")) & _near_enough(F.col("size"), F.col("of.pivot_size"))
                        & _room(F.col("size"), F.col("of.pivot_size"), differing))
    return tried.select(*_ordered(F.col("node"), F.col("of.pivot"))).distinct()


def open_members(members, components):
    """Members of the groups that lie in several components, with their own."""
    known = staged(members.join(components, "node"), "join-known")
    split = known.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return staged(known.join(split.where("low <> high").select("signature"), "signature"), "join-open")


def open_pairs(members):
    """Pairs of nodes of different components that a group says may be similar.

    Bitmaps say how many shingles two sets differ in at least. And the shingle behind a
    signature may be the first that two sets share. Then they share
    no more than what follows it in the shorter rest; a pair that needs more than that
    shares an earlier one, and is found there.
    """
    a, b = members.where("own").alias("a"), members.alias("b")
    rest = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    once = ~F.col("b.own") | (F.col("a.node") < F.col("b.node"))
    differing = _differing(lambda name: F.col(f"a.{name}"), lambda name: F.col(f"b.{name}"))
    met = a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("a.component") != F.col("b.component")) & once
                 & _near_enough(F.col("a.size"), F.col("b.size"))
                 & (rest * (WHOLE + SIMILAR) >= (F.col("a.size") + F.col("b.size")) * SIMILAR)
                 & _room(F.col("a.size"), F.col("b.size"), differing))
    return met.select(*_ordered(F.col("a.node"), F.col("b.node"))).distinct()


def _met_often(found):
    """(signature, node) of the groups of more than SMALL nodes."""
    hot = found.where("signature IS NOT NULL")
    return hot.select("signature", F.col("upper").alias("node")).unionByName(
        hot.select("signature", F.col("lower").alias("node"))).distinct()


def _small_groups(found):
    """The pairs of small groups and how many they share."""
    small = found.where("signature IS NULL")
    return small.groupBy("lower", "upper").agg(F.sum("shared").alias("shared"))


def linked_components(docs, digest, id_column="doc_id", text_column="text"):
    """(node, component) of the nodes compared, by the smallest node reached."""
    found = staged(candidate_pairs(node_signatures(docs, id_column, text_column)), "join-candidates")
    holders = digest.where("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("id"), F.min("spare").alias("spare"))
    hot = _met_often(found).groupBy("node").agg(F.count("*").alias("hot"))
    met = found.select(F.explode(F.array("lower", "upper")).alias("node")).distinct()
    # A similar pair shares `spare` + 1 signatures; `hot` of them may be those of large groups.
    counted = staged(met.join(holders, "node").join(hot, "node", "left").select(
        "node", "id", "spare", F.coalesce("hot", F.lit(0)).alias("hot")), "join-counted")
    need = counted.select("node", (F.col("spare") + 1 - F.col("hot")).alias("need"))
    pairs = _small_groups(found).join(need.toDF("lower", "lower_need"), "lower").join(
        need.toDF("upper", "upper_need"), "upper")
    pairs = staged(pairs.where("shared >= lower_need AND shared >= upper_need").select("lower", "upper"), "join-pairs")
    # Nodes whose partners may share no rarer signature.
    often = staged(counted.where("hot > spare").select("node"), "join-often")
    compared = pairs.select(F.explode(F.array("lower", "upper")).alias("node")).unionByName(often).distinct()
    wanted = compared.join(counted, "node").select("id").distinct()
    sets = staged(node_sets(docs, wanted, id_column, text_column), "join-sets")
    links = staged(verified(pairs, sets), "join-links")
    members = staged(class_signatures(staged(sets.join(often, "node", "left_semi"), "join-often")), "join-members")
    components, left = sets.select("node", F.col("node").alias("component")), members
    for number in range(PIVOT_ROUNDS):
        tried = staged(verified(staged(pivot_pairs(left, number), "join-pairs"), sets), "join-links")
        components = merged(components, links.unionByName(tried))
        left = open_members(members, components)
    if not left.isEmpty():
        last = staged(verified(staged(open_pairs(left), "join-pairs"), sets), "join-links")
        components = merged(components, last)
    return components


def joined(docs, id_column="doc_id", text_column="text"):
    """(id, size, component) of every row: the smallest id that links reach."""
    digest = staged(digests(docs, id_column, text_column), "join-digests")
    components = linked_components(docs, digest, id_column, text_column)
    return with_components(digest, components)


def with_components(digest, components):
    """Components of nodes as smallest ids of the rows."""
    rows = digest.where("id IS NOT NULL")
    known = rows.where("node IS NOT NULL").select("id", "node").distinct().join(components, "node", "left").select(
        "id", F.coalesce("component", "node").alias("component"))
    known = staged(known, "join-members")
    # An id with several texts ties their components together.
    ties = known.groupBy("id").agg(F.min("component").alias("lower"), F.max("component").alias("upper"))
    ties = ties.where("lower <> upper").select("lower", "upper")
    if not ties.isEmpty():
        merged = connected(staged(ties, "join-ties")).withColumnRenamed("component", "merged")
        known = staged(known.join(merged, known["component"] == merged["node"], "left").select(
            "id", F.coalesce("merged", "component").alias("component")), "join-members")
    least = staged(known.groupBy("component").agg(F.min("id").alias("least")), "join-least")
    by_id = known.join(least, "component").select("id", "least").groupBy("id").agg(F.min("least").alias("least"))
    return digest.join(by_id, "id", "left").select(
        "id", "size", F.coalesce("least", "id").alias("component"))
