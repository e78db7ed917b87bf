"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is one last token in its encoding. Going through the
prefixes, an automaton gives the tokens that end there, longest first; a token is the
last one if it stands compatibly next to the last token of the prefix before it. The
ids follow from the back-pointers.

Two tokens stand compatibly if no merge across their border would have come first.
While a left token is built, its rightmost part runs through the tokens down its
right side, and likewise a right token's leftmost part; each lasts until the merge
that swallows it. A pair of such parts that can merge, at a rank before either is
swallowed, would have merged. At equal rank the leftmost merge comes first.

Defined cases: NULL and empty texts have no tokens; texts of any length are encoded
whole; repeated rows are encoded alike. Rows keep their own columns.
"""

import hashlib
import json
import os
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.llm.batches import field_place, row_slices

#: Bytes of what a worker remembers: words, and pieces of text between white space in each
#: of two generations, so three times as much in all. Longer pieces are never remembered.
REMEMBERED = 40 << 20
LONGEST_REMEMBERED = 64
#: Pairs of tokens of which a worker remembers whether they stand compatibly.
REMEMBERED_PAIRS = 300_000
#: Bytes of an entry beside its letters: five objects and their place in the dictionary.
_ENTRY_BYTES = 380
_NEVER = 1 << 40
_END = "Ā"

# Bytes of Latin-1 texts that need no tables: ASCII without the separators that only
# Python takes for white space, and the letters.
_PLAIN = bytes(b for b in range(256)
               if b < 0x1C or 0x20 <= b < 0x80 or b >= 0xC0 and b not in (0xD7, 0xF7))
_PLAIN_WORDS = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r a-z0-9\xdf-\xf6\xf8-\xff]+"
)
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(
    rf"'(?:s|t|re|ve|m|ll|d)|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
)


def _byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return {chr(b if b in printed else next(spare)): b for b in range(256)}


def _entry_bytes(key, entry):
    return _ENTRY_BYTES + len(key) + len(entry[0]) + len(entry[1])


class WordBpe:
    """A word-end BPE vocabulary of the `tokenizers` file format."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        suffix = model["end_of_word_suffix"]
        self.names = {i: name for name, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.names.update({i: name for name, i in self.specials.items()})
        letters = _byte_letters()
        self.merges, self.left, self.right, self.made = {}, {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = model["vocab"][a + b]
            first, second = model["vocab"][a], model["vocab"][b]
            self.merges[first, second] = rank
            self.left[whole], self.right[whole], self.made[whole] = first, second, rank
        self.automaton = ahocorasick.Automaton()
        for name, i in model["vocab"].items():
            if name in self.specials:
                continue
            ended = name.endswith(suffix) and name != suffix
            body = name[:-len(suffix)] if ended else name
            if all(ch in letters for ch in body):
                key = "".join(chr(letters[ch]) for ch in body) + (_END if ended else "")
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self._sides, self._fits = {}, {}
        #: Pieces of text that are tokens as they stand.
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        #: What all of these begin with: a text without it has none.
        self._special_start = os.path.commonprefix(list(self.specials))
        self._new, self._old, self._word_entries = {}, {}, {}
        self._new_bytes = self._word_bytes = 0

    def _side(self, token, child):
        """The border parts of a token, outermost first: (part, rank that swallows it)."""
        out, lasts = [], _NEVER
        while token is not None:
            out.append((token, lasts))
            lasts = self.made.get(token, -1)
            token = child.get(token)
        return out

    def _border(self, token, on_right):
        key = token * 2 + on_right
        side = self._sides.get(key)
        if side is None:
            side = self._sides[key] = self._side(token, self.right if on_right else self.left)
        return side

    def compatible(self, first, second):
        key = first << 20 | second
        fits = self._fits.get(key)
        if fits is None:
            if len(self._fits) >= REMEMBERED_PAIRS:
                self._fits.clear()
            fits = self._fits[key] = self._compatible(first, second)
        return fits

    def _compatible(self, first, second):
        ranks = self.merges
        heads = self._border(second, False)
        for part, swallowed in self._border(first, True):
            for head, head_swallowed in heads:
                rank = ranks.get((part, head))
                if rank is not None and rank < swallowed and rank <= head_swallowed:
                    return False
        return True

    def encode_word(self, word):
        """Ids of one word; the last token of each prefix is stored, then followed back."""
        symbols = word.encode().decode("latin-1") + _END
        size = len(symbols)
        last, starts = [-1] * (size + 1), [0] * (size + 1)
        fits = self._fits
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fit = fits.get(before << 20 | token)
                if fit is None:
                    fit = self.compatible(before, token)
                if not fit:
                    continue
                starts[end] = start
            last[end] = token
        ids, at = [], size
        while at:
            ids.append(last[at])
            at = starts[at]
        return ids[::-1]

    def _word_entry(self, word):
        """(ids as text, decoded text) of a word."""
        entry = self._word_entries.get(word)
        if entry is None:
            ids = self.encode_word(word)
            entry = (" ".join(map(str, ids)), self.decode(ids))
            if len(word) <= LONGEST_REMEMBERED:
                self._word_bytes += _entry_bytes(word, entry)
                if self._word_bytes > REMEMBERED:
                    self._word_entries.clear()
                    self._word_bytes = _entry_bytes(word, entry)
                self._word_entries[word] = entry
        return entry

    def _piece_entry(self, piece):
        """The same of a run without white space, which words never reach across.

        A word with a stop or comma is put together from its parts: remembering such
        runs would push words out.
        """
        if piece[-1] in ".," and piece[:-1].isalpha():
            word, sign = self._new.get(piece[:-1]) or self._piece_entry(piece[:-1]), self._word_entry(piece[-1])
            return word[0] + " " + sign[0], word[1] + " " + sign[1]
        entry = self._old.get(piece)
        if entry is None:
            if piece.isalpha():
                ids = self.encode_word(piece)
                entry = (" ".join(map(str, ids)), self.decode(ids))
            else:
                entries = [self._word_entry(word) for word in _PLAIN_WORDS.findall(piece)]
                entry = (" ".join([e[0] for e in entries]), " ".join([e[1] for e in entries]))
        if len(piece) <= LONGEST_REMEMBERED:
            self._new_bytes += _entry_bytes(piece, entry)
            if self._new_bytes > REMEMBERED:
                self._old, self._new, self._new_bytes = self._new, {}, _entry_bytes(piece, entry)
            self._new[piece] = entry
        return entry

    def _plain_entries(self, text):
        """Entries of a text of plain Latin-1; None if it is not one."""
        try:
            if text.encode("latin-1").translate(None, _PLAIN):
                return None
        except UnicodeEncodeError:
            return None
        pieces = text.lower().split()
        entries = list(map(self._new.get, pieces))
        if None in entries:
            entries = [e or self._new.get(p) or self._piece_entry(p) for p, e in zip(pieces, entries)]
        return entries

    @staticmethod
    def words(text):
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: a final sigma is lower-cased like any other.
        return _WORDS.findall(text.replace("Σ", "σ").lower())

    def entries(self, text):
        """(ids as text, decoded text) of the parts of a text, in order."""
        if self._special is not None and self._special_start in text:
            pieces = self._special.split(text)
        else:
            pieces = [text]
        out = []
        for piece in pieces:
            if piece in self.specials:
                token = self.specials[piece]
                out.append((str(token), self.names[token]))
                continue
            entries = self._plain_entries(piece)
            if entries is None:
                entries = [self._word_entry(word) for word in self.words(piece)]
            out = out + entries if out else entries
        return out

    def encode(self, text):
        return [int(i) for entry in self.entries(text) for i in entry[0].split(" ")]

    def decode(self, ids):
        """Names of the tokens joined by spaces, as a file without a decoder asks for."""
        return " ".join([self.names[i] for i in ids])


_loaded = {}


def load(path):
    """The vocabulary at `path`, read once in each process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _encoder(path, place, with_ids):
    """Adds the columns of `encoded` for the text, field number `place` of `row`."""

    def encode(batches):
        vocabulary = load(path)
        for piece, _ in (found for batch in batches for found in row_slices(batch, place)):
            counts, lists, id_digests, text_digests = [], [], [], []
            for text in piece.column(0).field(place).to_pylist():
                entries = vocabulary.entries(text) if text else []
                written = " ".join([e[0] for e in entries])
                decoded = " ".join([e[1] for e in entries])
                counts.append(written.count(" ") + 1 if written else 0)
                lists.append(np.array(written.split(), np.int32) if with_ids else None)
                id_digests.append(hashlib.sha256(written.encode()).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(pa.int32())),
                 pa.array(id_digests), pa.array(text_digests)],
                names=["row", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    return encode


def encoded(docs, path, text_column="text", with_ids=True):
    """(row, n_tokens, ids, ids_sha256, decoded_sha256) of every row.

    `path` is a vocabulary file that every executor has, as part of its Python
    installation. `ids` is NULL unless asked for.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    return rows.mapInArrow(_encoder(path, field_place(docs, text_column), with_ids), schema)


def decoded(encodings, path):
    """Adds `decoded`, the text of the `ids` of each row, to (row, ids) pairs."""

    def decode(batches):
        vocabulary = load(path)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["row", "ids", "decoded"],
            )

    pairs = encodings.select("row", "ids")
    return pairs.mapInArrow(decode, T.StructType([*pairs.schema, T.StructField("decoded", T.StringType())]))
