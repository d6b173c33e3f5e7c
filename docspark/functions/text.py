"""Text functions with Python's notion of white space, letters and digits, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that str.isspace accepts, as a Java character class body.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# the same class, and its opposite, with the usual characters told first
_IS_SPACE, _NO_SPACE = f"[[^!-~]&&[{SPACE}]]", f"[!-~[^{SPACE}]]"
# letters one by one up to U+00FF: Java tells those from a table, and ranges and properties by a chain of calls
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha()) + r"\p{L}"
_DIGIT_OR_ODD = "[^" + "".join(f"\\x{i:02x}" for i in range(32, 127) if not chr(i).isdigit()) + "]"


def let(value: Column, use) -> Column:
    """What ``use`` makes of a value, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """The words between white space, like str.split()."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda t: t != "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def word_count(text: Column) -> Column:
    """The number of words between white space, without a list of them."""
    return let(spaced(brief(text)), spaced_word_count)


def brief(text: Column) -> Column:
    """A text with one ``a`` for each run of letters: all else that the signals look at is in it, at a fraction of the length."""
    return F.regexp_replace(text, f"[{_LETTERS}]++", "a")


def is_odd(text: Column) -> Column:
    """Whether a text has a character that is not printable ASCII."""
    return text.rlike("[^ -~]")


def has_digit(text: Column) -> Column:
    """False only where a text has no digit of any script."""
    return text.rlike(_DIGIT_OR_ODD)


def spaced(text: Column, odd: Column | None = None) -> Column:
    """A text with one plain space between words and none around them; only odd texts are looked through for other spaces."""
    one = lambda t: F.when(is_odd(t) if odd is None else odd, F.regexp_replace(t, f"{_IS_SPACE}++", " ")).when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  ++", " ")).otherwise(t)
    return F.trim(let(F.replace(text, F.lit("\n"), F.lit(" ")), one))


def spaced_word_count(text: Column) -> Column:
    """The number of words of a ``spaced`` text."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)


def strip(text: Column) -> Column:
    """White space off both ends, like str.strip()."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def truncate_words(text: Column, most: int | Column) -> Column:
    """``text`` itself up to ``most`` words; beyond, the first ``most`` joined by a space, and three dots."""
    most = F.lit(most) if isinstance(most, int) else most
    words = tokens(text)
    return F.when(F.size(words) <= most, text).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), most), " "), F.lit("...")))


DIGIT = r"[\p{Nd}²³¹]"
GARBLED = r"[A-Za-z]\p{Nd}|\p{Nd}[A-Za-z]"


def is_number_token(token: Column) -> Column:
    """A number with the usual signs of amounts, dates and ranges."""
    bare = F.regexp_replace(F.regexp_replace(token, r"^[()\[\].,%$:/+-]+|[()\[\].,%$:/+-]+\z", ""), "[,./]", "")
    return bare.rlike(rf"^{DIGIT}+\z")


def is_content_token(token: Column) -> Column:
    """A word of letters, or a number."""
    return token.rlike(r"^\p{L}+\z") | is_number_token(token)


def is_garbled_token(token: Column) -> Column:
    """A Latin letter next to a digit."""
    return token.rlike(GARBLED)


SIGNS = r"()\[\].,%$:/+-"
# what is_number_token accepts, as a whole word of a ``spaced`` text
NUMBER_WORD = rf"(?<![^ ])[{SIGNS}]*+{DIGIT}[{DIGIT[1:-1]},./]*+[{SIGNS}]*+(?![^ ])"


def content_word_count(spaced_brief: Column, digit: Column | None = None) -> Column:
    """The number of words that are letters throughout, or numbers, of a ``spaced`` ``brief`` text; ``digit``: its ``has_digit``, if known."""
    digit = has_digit(spaced_brief) if digit is None else digit
    one = F.when(digit, F.regexp_replace(spaced_brief, NUMBER_WORD, "a")).otherwise(spaced_brief)
    apart = F.concat(F.lit(" "), F.replace(one, F.lit(" "), F.lit("  ")), F.lit(" "))
    return let(apart, lambda t: F.floor((F.length(t) - F.length(F.replace(t, F.lit(" a ")))) / 3).cast("int"))


def garbled_word_count(text: Column, brief_text: Column, digit: Column | None = None) -> Column:
    """The number of words with a Latin letter next to a digit; words are listed only with a digit, where a letter is next to one."""
    with_digit = rf"(?<![^{SPACE}])[^{SPACE}\p{{Nd}}]*+\p{{Nd}}{_NO_SPACE}*+"
    found = F.size(F.filter(F.regexp_extract_all(text, F.lit(with_digit), F.lit(0)), is_garbled_token))
    digit = has_digit(brief_text) if digit is None else digit
    return F.when(digit & brief_text.rlike(r"a\p{Nd}|\p{Nd}a"), found).otherwise(0)


def has_repeated_run(text: Column) -> Column:
    """One character, not a line feed, seven times or more in a row."""
    return text.rlike(r"(?d)(.)\1\1\1\1\1\1")


def printable_ratio(text: Column, brief_text: Column | None = None) -> Column:
    """Printable characters over all (1 at least); of white space only the plain space is printable.  Letters are printable."""
    return ratio_of_printable(F.length(text), unprintable_count(text if brief_text is None else brief_text))


def ratio_of_printable(size: Column, lost: Column) -> Column:
    return (size - lost).cast("double") / F.greatest(size, F.lit(1)).cast("double")


def unprintable_count(text: Column, odd: Column | None = None) -> Column:
    """The number of characters that are not printable; apart from line feeds they are looked for in odd texts only."""
    kept = lambda t: F.when(is_odd(t) if odd is None else odd, F.length(F.regexp_replace(t, r"[[^ -~]&&[\p{C}\p{Z}]]", ""))).otherwise(F.length(t))
    return F.length(text) - let(F.replace(text, F.lit("\n"), F.lit("")), kept)


# a model's thinking, in the order in which it is taken out
THINKING = (r"(?is)<think>.*?</think>", r"(?is)<thinking>.*?</thinking>")


def strip_thinking(text: Column) -> Column:
    """A model's answer without its thinking spans, stripped."""
    for span in THINKING:
        text = F.regexp_replace(text, span, "")
    return strip(text)


def two_decimals(ratio: Column) -> Column:
    """A ratio from 0 to under 0.3 with two decimals, rounded by its exact binary value, ties to even.

    2**60 times such a number of at least 2**-8 is a whole number; smaller ones are far from a tie, so cutting changes nothing.
    25 times that fits 64 bits, and in it a hundredth is 2**58.
    """
    scaled = (ratio * F.lit(float(1 << 60))).cast("bigint") * 25
    whole, rest, half = F.shiftright(scaled, 58), scaled.bitwiseAND(F.lit((1 << 58) - 1)), F.lit(1 << 57)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return F.concat(F.lit("0."), F.lpad((whole + up.cast("bigint")).cast("string"), 2, "0"))


def heading(text: Column, level: Column) -> Column:
    """``text`` after the number signs of its level (1 to 6; 1 if null), unless it starts with one."""
    marks = F.expr("repeat('#', 6)")
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1))))
    return F.when(F.startswith(text, F.lit("#")), text).otherwise(F.concat(F.substring(marks, F.lit(1), n), F.lit(" "), text))


def escape_cell(text: Column) -> Column:
    """Text fit for a Markdown table cell."""
    return strip(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b).cast("double") / longer.cast("double"))
