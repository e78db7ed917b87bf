"""Line dedup by a tree of line templates.

A line, and each sentence of a line that has several, is a unit. Its tokens with a digit
are variable fields, where enough words are left to tell the template: rows of numbers,
dates or table cells stand for themselves. A unit goes down a tree of fixed depth: first by
its number of tokens, then by its leading tokens. In the leaf it ends in, templates are
compared with each other: the tokens after the leading ones are cut into four stretches,
and templates of the leaf that differ in one of them alone are one template with a field
there. A template found in more than one document is dropped from all but the document of
the smallest id.

Only units of MERGED tokens are merged, so a field is five tokens at most and prose
stays: other units of a leaf are one template only if they are equal but for digits. A
template may be merged with several, through different fields; each of its units goes if
an earlier document has any of these.

Defined cases: NULL texts stay NULL and empty ones empty; units of fewer tokens than
LINE_TOKENS or SENTENCE_TOKENS are kept; rows that share an id count as one document,
and rows without an id as one more, which comes first; a unit repeated inside one
document alone is kept. Very long texts are rows of their own length and nothing more.
Other columns are kept as they are.
"""

from pyspark.sql import functions as F

from fleetmeter.sources.staging import staged

LEADING_TOKENS = 3
#: Least tokens of a line, and of a sentence inside a line, that counts as repeated.
LINE_TOKENS = 3
SENTENCE_TOKENS = 6

#: Least tokens with a letter of a template with fields; they are also more than half of it.
FIXED_TOKENS = 3

VARIABLE = "[^\\s0-9]*+[0-9]\\S*"
FIELD = "<*>"

#: Tokens of units whose templates a leaf merges, and the stretches their rest is cut into.
MERGED = (8, 23)
STRETCHES = 4

# The point after a sentence's end, and a mark put there, which is faster to split at where
# the text has none of its own.
_AFTER_SENTENCE, _MARK = "(?<=[.!?] )", "\x01"
_SENTENCE_ENDS = (". ", "! ", "? ")

_FIRST = -(1 << 63)


def _replaced(text, old, new):
    return F.replace(text, F.lit(old), F.lit(new))


def sentences_of(line):
    """A line as an array of sentences; an end at the end of the line opens an empty one."""
    marked = line
    for end in _SENTENCE_ENDS:
        marked = _replaced(marked, end, end + _MARK)
    return F.when(F.instr(line, _MARK) > 0, F.split(line, _AFTER_SENTENCE)).otherwise(F.split(marked, _MARK))


def generalised(unit):
    """Tokens with a digit as fields; `unit` is trimmed."""
    return F.when(unit.rlike("[0-9]"), F.regexp_replace(unit, VARIABLE, FIELD)).otherwise(unit)


def told_apart(template, tokens):
    """Whether a template with fields has the words to be one."""
    fixed = F.regexp_count(template, F.lit("\\p{L}\\S*"))
    return (fixed >= FIXED_TOKENS) & (2 * fixed > tokens)


def _occurrences(text, part):
    return (F.octet_length(text) - F.octet_length(_replaced(text, part, ""))) / F.lit(len(part))


def _document(id_column):
    return F.coalesce(F.col(id_column).cast("long"), F.lit(_FIRST))


def _stretch(number):
    """Hash of a stretch of the tokens after the leading ones; NULL in units that are not merged."""
    count = F.size("words")
    size = F.ceil((count - LEADING_TOKENS) / STRETCHES).cast("int")
    own = F.hash(F.slice("words", size * number + (LEADING_TOKENS + 1), size))
    return F.when(count.between(*MERGED), own).alias(f"stretch_{number}")


_STRETCHES = [f"stretch_{number}" for number in range(STRETCHES)]


def units(docs, id_column, text_column):
    """One row for each unit: document, text hash, line, part (0: the line), and its place in the tree.

    `leaf` stands for the number of tokens and the leading ones, `template` for all of them.
    """
    # Each step is a projection of its own: what is used more than once is made once.
    texts = docs.select(_document(id_column).alias("document"), F.xxhash64(text_column).alias("text_hash"),
                        F.split(text_column, "\n").alias("lines"))
    # The outer form infers no condition that would split each text once more.
    lines = texts.select("document", "text_hash", F.posexplode_outer("lines").alias("line", "content"))
    sentences = lines.select("document", "text_hash", "line", "content", sentences_of(F.col("content")).alias("sentences"),
                             F.col("content").rlike("[0-9]").alias("digits"))
    parts = F.when(F.size("sentences") > 1, F.concat(F.array("content"), F.col("sentences"))).otherwise(F.col("sentences"))
    every = sentences.select("document", "text_hash", "line", "digits", F.posexplode(parts).alias("part", "unit"))
    every = every.withColumn("unit", F.btrim("unit", F.lit(" ")))
    every = every.withColumn("masked", F.when(F.col("digits"), generalised(F.col("unit"))).otherwise(F.col("unit")))
    told = F.when(F.col("digits"), (F.col("masked") == F.col("unit")) | told_apart(
        F.col("masked"), F.size(F.split("masked", " ")))).otherwise(True)
    every = every.withColumn("kept", F.when(told, F.col("masked")).otherwise(F.col("unit")))
    every = every.withColumn("words", F.split("kept", " "))
    least = F.when(F.col("part") == 0, LINE_TOKENS).otherwise(SENTENCE_TOKENS)
    place = F.struct(
        F.xxhash64(F.size("words"), F.slice("words", 1, LEADING_TOKENS)).alias("leaf"), F.xxhash64("kept").alias("template"),
        *[_stretch(number) for number in range(STRETCHES)])
    # A generator in place of a condition, which would be moved down and split each unit once more.
    long = F.when(F.size("words") >= least, F.array(place))
    return every.select("document", "text_hash", "line", "part", F.inline(long))


def merged_templates(templates):
    """(leaf, template, merged): the first document of any template of the leaf that differs in one stretch."""
    several = templates.where(F.col(_STRETCHES[0]).isNotNull()).groupBy("leaf").agg(F.count("*").alias("held")).where("held > 1")
    rivals = templates.join(several.select("leaf"), "leaf")
    without = F.array(*[F.xxhash64("leaf", F.lit(field), *[s for i, s in enumerate(_STRETCHES) if i != field])
                        for field in range(STRETCHES)])
    fields = rivals.where(F.col(_STRETCHES[0]).isNotNull()).select("leaf", "template", "first", F.explode(without).alias("field"))
    fields = staged(fields, "line-fields")
    alike = fields.groupBy("field").agg(F.count("*").alias("held"), F.min("first").alias("merged")).where("held > 1")
    return fields.join(alike, "field").groupBy("leaf", "template").agg(F.min("merged").alias("merged"))


def recurring(all_units):
    """(leaf, template, keeper): templates of more than one document, and the document that keeps them."""
    templates = staged(all_units.groupBy("leaf", "template").agg(
        F.min("document").alias("first"), F.max("document").alias("last"), *[F.min(s).alias(s) for s in _STRETCHES]),
        "line-templates")
    merged = merged_templates(templates)
    found = templates.join(merged, ["leaf", "template"], "left").withColumn("keeper", F.least("first", "merged"))
    return found.where("keeper <> last").select("leaf", "template", "keeper")


_CODE = 1 << 32


def deduplicated(docs, id_column="doc_id", text_column="text"):
    """(row, kept_text, n_units, n_dropped): every row, and its text without dropped units.

    `n_units` are the sentences of the text, `n_dropped` those dropped. The units, hashes
    only, are written once; so are the recurring templates, so that a template in a third of all documents can
    be split between tasks when the units meet it.
    """
    all_units = staged(units(docs, id_column, text_column), "line-units")
    repeated = staged(recurring(all_units), "line-recurring")
    dropped = all_units.join(repeated, ["leaf", "template"]).where("document <> keeper")
    codes = dropped.select("document", "text_hash", (F.col("line") * F.lit(_CODE) + F.col("part")).alias("code"))
    marks = codes.groupBy("document", "text_hash").agg(F.collect_set("code").alias("codes"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), _document(id_column).alias("document"), F.xxhash64(text_column).alias("text_hash"),
    )
    # Texts are dealt but not sorted: what is looked up are the codes, a few numbers for each text.
    joined = rows.join(marks.hint("shuffle_hash"), ["document", "text_hash"], "left").withColumn(
        "text", F.col(f"row.`{text_column}`"))
    # Only for texts that lose something: lines as arrays of sentences, the codes of
    # all sentences of lines not dropped whole, and of these the codes not dropped.
    nested = F.when(F.col("codes").isNotNull(), F.transform(F.split("text", "\n"), sentences_of))
    joined = joined.withColumn("nested", nested)
    lines = F.sequence(F.lit(0), F.size("nested") - 1)
    whole = F.array_except(F.transform(lines, lambda line: line.cast("long") * F.lit(_CODE)), F.col("codes"))
    every = F.flatten(F.transform(whole, lambda code: F.transform(
        F.sequence(F.lit(1), F.size(F.get("nested", F.shiftright(code, 32).cast("int")))),
        lambda part: code + part,
    )))
    joined = joined.withColumn("kept", F.array_except(every, F.col("codes")))

    def piece(code):
        """A sentence, the last of a line with the line's end."""
        line, part = F.shiftright(code, 32).cast("int"), (code % F.lit(_CODE)).cast("int")
        own = F.get("nested", line)
        ends = (part == F.size(own)) & (line < F.size("nested") - 1)
        return F.when(ends, F.concat(F.get(own, part - 1), F.lit("\n"))).otherwise(F.get(own, part - 1))

    text = F.array_join(F.transform("kept", piece), "")
    sentences = F.lit(1) + sum(_occurrences(F.col("text"), end) for end in ("\n", ". ", "! ", "? "))
    counted = F.coalesce(sentences.cast("long"), F.lit(0).cast("long"))
    return joined.select(
        "row",
        F.when(F.col("codes").isNull(), F.col("text")).otherwise(text).alias("kept_text"),
        counted.alias("n_units"),
        F.when(F.col("codes").isNull(), 0).otherwise(counted - F.size("kept")).cast("long").alias("n_dropped"),
    )


def without_repetition(docs, id_column="doc_id", text_column="text"):
    """Documents without dropped units; those left with nothing go, empty ones stay."""
    # A numbered row keeps the condition above the rebuilt text: pushed below, it would
    # rebuild the text inside the condition, once for each sentence.
    found = deduplicated(docs, id_column, text_column).withColumn("number", F.monotonically_increasing_id())
    blank = F.trim(F.regexp_replace("kept_text", "\\s+", " ")) == ""
    left = found.where((F.col("number") >= 0) & ~F.coalesce((F.col("n_dropped") > 0) & blank, F.lit(False)))
    return left.select(*[
        F.col("kept_text").alias(name) if name == text_column else F.col(f"row.`{name}`").alias(name)
        for name in docs.columns
    ])
