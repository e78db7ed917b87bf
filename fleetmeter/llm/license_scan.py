"""License scans by a positional index of rare words.

A template is a run of licence words with key phrases that must be there. For each
template the words of its key phrases with the highest inverse document frequency
are its anchors; frequencies are counted over all texts given. In each text the
places of anchor words are looked up, each place stands for a start of the template,
the starts that all anchors of a template agree on are its candidates, and those
with every key phrase in its place are matches. Other words of a template may
differ; their share that fits is the match's score.

Everything is a DataFrame expression of one row: no shuffle but the word counts,
which are one row for each word of the templates.

Defined cases: NULL and empty texts have no words and no matches; repeated rows are
scanned alike; frequencies of an empty table are zero and anchors then follow the
alphabet. Rows keep their own columns.
"""

from pyspark.sql import functions as F

ANCHORS = 2

# Base phrases, (label, phrase).
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Templates of our own: (label, words, key phrases).
OWN_TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ("permission is hereby granted", "obtaining a copy of this software")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use", "source and binary forms")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     ("permission to use copy modify", "distribute this software")),
    ("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2", "mozilla public license version 2", ("mozilla public license version 2",)),
    ("cc-by", "creative commons attribution 4 0 international license",
     ("creative commons attribution", "international license")),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software", "public domain")),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template:
    """Words with key phrases as (offset, words)."""

    def __init__(self, label, words, phrases, base):
        self.label, self.words, self.base = label, words.split(" "), base
        self.phrases = []
        for phrase in phrases:
            part = phrase.split(" ")
            offset = next(i for i in range(len(self.words)) if self.words[i:i + len(part)] == part)
            self.phrases.append((offset, part))

    def key_words(self):
        """Each key word with its first place in the template."""
        places = {}
        for offset, part in self.phrases:
            for i, word in enumerate(part):
                places.setdefault(word, offset + i)
        return places

    def anchors(self, frequency):
        """The rarest key words with their places."""
        places = self.key_words()
        ranked = sorted(places, key=lambda word: (frequency.get(word, 0), word))
        return [(word, places[word]) for word in ranked[:ANCHORS]]


def templates():
    return [Template(label, phrase, (phrase,), True) for label, phrase in BASE_PHRASES] + [
        Template(label, words, phrases, False) for label, words, phrases in OWN_TEMPLATES
    ]


def _words(text_column):
    """Words as they are written; A-Z are lower-cased where words are compared."""
    parts = F.split(F.coalesce(F.col(text_column), F.lit("")), SEPARATORS)
    return F.filter(parts, lambda word: word != "")


def document_frequency(docs, known, text_column="text"):
    """In how many texts each of the licence words stands: word -> count."""
    vocabulary = sorted({word for template in known for word in template.key_words()})
    words = docs.select(_words(text_column).alias("words"))
    own = F.array_distinct(F.filter(F.transform("words", F.lower), lambda word: word.isin(vocabulary)))
    counted = words.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("texts"))
    # One row for each licence word of the templates.
    return {row["word"]: row["texts"] for row in counted.collect()}


def _word_at(place):
    return F.get(F.col("words"), place.cast("int"))


def _candidates(anchors):
    """Starts that every anchor agrees on."""
    agreed = None
    for word, offset in anchors:
        own = F.filter("anchor_places", lambda place: F.lower(_word_at(place)) == word)
        starts = F.filter(F.transform(own, lambda place: place - offset), lambda start: start >= 0)
        agreed = starts if agreed is None else F.array_intersect(agreed, starts)
    return agreed


def _lowered(words):
    return F.transform(words, lambda word: F.translate(word, UPPER, LOWER))


def _has_phrases(template, start):
    tests = None
    for offset, part in template.phrases:
        found = _lowered(F.slice(F.col("words"), start + (offset + 1), len(part)))
        test = found == F.array(*[F.lit(word) for word in part])
        tests = test if tests is None else tests & test
    return tests


def _share(template, start):
    """Share of the template's words that stand in their places."""
    if sum(len(part) for _, part in template.phrases) == len(template.words):
        return F.lit(1.0)
    found = _lowered(F.slice(F.col("words"), start + 1, len(template.words)))
    same = F.zip_with(found, F.array(*[F.lit(w) for w in template.words]), lambda a, b: a.eqNullSafe(b))
    return F.size(F.filter(same, lambda s: s)).cast("double") / len(template.words)


def scanned(docs, text_column="text", known=None):
    """(row, n_words, matches): matches are structs (label, base, start, score)."""
    known = known or templates()
    frequency = document_frequency(docs, known, text_column)
    anchors = {id(t): t.anchors(frequency) for t in known}
    looked_up = sorted({word for pairs in anchors.values() for word, _ in pairs})
    rows = docs.select(F.struct(*docs.columns).alias("row"), _words(text_column).alias("words"))
    numbers = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    places = F.filter(numbers, lambda place: F.lower(_word_at(place)).isin(looked_up))
    rows = rows.withColumn("anchor_places", places)

    def match(template):
        starts = F.filter(_candidates(anchors[id(template)]), lambda start: _has_phrases(template, start))
        return F.transform(starts, lambda start: F.struct(
            F.lit(template.label).alias("label"), F.lit(template.base).alias("base"),
            start.cast("long").alias("start"), _share(template, start).alias("score"),
        ))

    found = F.flatten(F.array(*[match(template) for template in known]))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,score:double>>")
    return rows.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.when(F.size("anchor_places") > 0, found).otherwise(none).alias("matches"),
    )


def labelled(matches):
    """Labels of matches, distinct and sorted, as text."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
