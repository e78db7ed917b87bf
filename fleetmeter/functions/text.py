"""Display text for amounts, and cleaning of product names."""

from pyspark.sql import functions as F

from fleetmeter.fixed_values import BLANKS, BRANDS, NO_LETTER, PRICE_PREFIX, SCALES, WORD_WITH_DIGIT


def _decimal(column):
    # 19 whole and 6 decimal digits: times the smallest factor still fits 38 digits.
    # Larger amounts are written another way, and are left out here.
    return F.when(F.abs(column) < F.lit(1e19), column).cast("decimal(25,6)")


def whole_digits(column):
    """Every digit of a double without a fraction, below 2^125 in size.

    A double is 53 bits times a power of two. It is cut at 2^62: both halves are exact
    and fit a long, and are put together as a decimal. Casting the double itself would
    fill up with zeros after its shortest spelling.
    """
    size = F.abs(column)
    high = F.floor(size / float(1 << 62))
    low = (size - high.cast("double") * float(1 << 62)).cast("long")
    whole = high.cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    return F.concat(F.when(column < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"))


_LARGEST = float(1 << 125)


def _written(column):
    """Two decimals of an amount of 1e6 or more in size; from 2^53 on there is no fraction."""
    whole = (F.abs(column) >= float(1 << 53)) & (F.abs(column) < _LARGEST)
    return F.when(whole, F.concat(whole_digits(F.when(whole, column)), F.lit(".00"))).otherwise(
        F.format_string("%.2f", column))


def _scaled(column, prefix, small, large):
    """Largest scale the amount reaches, two decimals, ties to even.

    `small` writes an amount below a thousand, `large` takes the text of one below -1e19.
    """
    amount = _decimal(column)
    power, letter = SCALES[0]
    text = F.when(column >= F.lit(1e18), F.concat(
        F.lit(prefix), _written(column / float(10 ** power)), F.lit(f" {letter}")))
    # Debts of any size are below a thousand.
    text = text.when(column <= F.lit(-1e19), F.concat(F.lit(prefix), large(_written(column))))
    for power, letter in SCALES:
        factor = F.expr(f"cast('1e-{power}' as decimal({power},{power}))")
        value = F.bround(amount * factor, 2).cast("decimal(24,2)").cast("string")
        piece = F.concat(F.lit(prefix), value, F.lit(f" {letter}"))
        reached = column >= F.lit(float(10 ** power))
        text = text.when(reached, piece)
    text = text.when(column.isNotNull(), F.concat(F.lit(prefix), small(amount)))
    return F.translate(text, ".", ",")


def price_text(column):
    """`Rp 1,12 rb`; below a thousand two decimals. NULL stays NULL."""
    return _scaled(
        column, PRICE_PREFIX, lambda amount: F.bround(amount, 2).cast("decimal(24,2)").cast("string"),
        lambda text: text,
    )


def number_text(column):
    """`1,12 rb`; below a thousand no decimals. NULL stays NULL."""
    return _scaled(
        column, "", lambda amount: F.bround(amount, 0).cast("decimal(24,0)").cast("string"),
        lambda text: F.substring_index(text, ".", 1),
    )


def grouped_text(column):
    """Whole number with a comma between thousands, ties away from zero."""
    return F.format_number(F.round(column, 0), 0)


def clean_name(column):
    """Product name without words that hold digits, brand words and non-letters.

    The order of the steps matters: `15W40` goes as one word before its digits
    could be stripped. Brand words are removed in one pass, since taking out a
    whole word never forms another.
    """
    brands = "|".join(BRANDS)
    text = F.regexp_replace(column, f"(?U){WORD_WITH_DIGIT}", "")
    text = F.regexp_replace(text, rf"(?iU)\b(?:{brands})\b", "")
    text = F.regexp_replace(text, f"(?U){NO_LETTER}", "")
    return F.trim(F.regexp_replace(text, f"(?U){BLANKS}", " "))


def first_words(column, count=2):
    return F.array_join(F.slice(F.split(column, " "), 1, count), " ")


def word_count(column):
    """Words of a cleaned name; the empty name has none."""
    return F.when(column == "", F.lit(0)).otherwise(F.size(F.split(column, " ")))
