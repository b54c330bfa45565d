"""Text cleaning and tokenising as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from declara import constants as K
from declara.functions.vectors import let


def char_class(characters: str) -> str:
    """A regex class holding exactly ``characters``."""
    return "[" + re.sub(r"([\\\]\[^\-&~|])", r"\\\1", characters) + "]"


# ASCII marks are padded by both lists of the cleaning rule, '^' by one only.
PAD_TWICE = char_class(K.ASCII_PUNCTUATION.replace("^", ""))
PAD_ONCE = char_class(K.PADDED_CHARACTERS)
# A class of many wide characters is tested one by one, so ASCII characters are ruled out first.
NOT_ASCII = "(?=[^\\x00-\\x7F])"
ANY_MARK = char_class(K.PADDED_CHARACTERS + K.ASCII_PUNCTUATION)


def deaccent(text: Column) -> Column:
    for ligature, letters in K.LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return F.translate(text, K.ACCENTED, K.UNACCENTED)


def fold(text: Column) -> Column:
    """Lower case without accents: the form in which names and words are compared."""
    return deaccent(F.lower(text))


def match_key(text: Column) -> Column:
    """Comparison key of a label: folded, without spaces."""
    return F.replace(fold(text), F.lit(" "), F.lit(""))


def fix_misspellings(text: Column) -> Column:
    """Replace every known misspelling, longer ones first, also inside words."""
    for wrong in sorted(K.MISSPELLINGS, key=len, reverse=True):
        text = F.replace(text, F.lit(wrong), F.lit(K.MISSPELLINGS[wrong]))
    return text


def _repair(text: Column) -> Column:
    text = F.replace(text, F.lit("\x9c"), F.lit("oe"))
    text = F.replace(text, F.lit("\x92"), F.lit("'"))
    return F.translate(text, "\r\n\t", "   ")


def clean_text(text: Column) -> Column:
    """Repair encoding, drop elided articles and set spaces around every mark."""
    text = _repair(text)
    for article in K.ELIDED_ARTICLES:
        text = F.replace(text, F.lit(article), F.lit(""))
    text = F.regexp_replace(text, f"({PAD_TWICE})", "  $1  ")
    text = F.replace(text, F.lit("^"), F.lit(" ^ "))
    text = F.regexp_replace(text, f"{NOT_ASCII}({PAD_ONCE})", " $1 ")
    return F.replace(text, F.lit("\x85"), F.lit(""))


def strip_marks(text: Column) -> Column:
    """The variant that removes the marks and keeps the articles."""
    text = F.regexp_replace(_repair(text), char_class(K.ASCII_PUNCTUATION), "")
    return F.replace(F.regexp_replace(text, f"{NOT_ASCII}{PAD_ONCE}", ""), F.lit("\x85"), F.lit(""))


def drop_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def preprocess_text(text: Column) -> Column:
    """The whole cleaning chain; a missing text becomes the empty string."""
    cleaned = fix_misspellings(drop_numbers(clean_text(F.lower(text))))
    cleaned = F.replace(squeeze(F.regexp_replace(cleaned, r"^\s+|\s+$", "")), F.lit("/"), F.lit(""))
    return F.coalesce(cleaned, F.lit(""))


def normalise_spacing(text: Column) -> Column:
    """Line ends to spaces, a space after digit runs and after slashes, single spaces."""
    text = F.translate(text, "\r\n", "  ")
    text = F.regexp_replace(text, r"([0-9]+)([^0-9])", "$1 $2")
    text = F.regexp_replace(text, r"([\\/])([\p{L}\p{N}_])", "$1 $2")
    return squeeze(text)


def tokens(text: Column, stop_words: Iterable[str] = tuple(K.STOP_WORDS + K.MEASURE_WORDS)) -> Column:
    """Folded words of three letters and more, without stop words and numbers."""
    words = F.split(fold(text), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(stop_words)))
    # split() builds its pattern for every word, so only words with a digit are cut
    letters = F.flatten(F.transform(kept, lambda w: F.when(w.rlike("[0-9]"), F.split(w, "[0-9]+")).otherwise(F.array(w))))
    return F.filter(letters, lambda w: F.length(w) > 2)


def bag(words: Column) -> Column:
    """Array of (term, tf) of a word list: sorted, then cut where the word changes. Counting inside
    the row needs no shuffle by document."""

    def count(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(starts, lambda a: F.zip_with(
            a, F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(s) + 1)),
            lambda i, end: F.struct(F.get(s, i - 1).alias("term"), (end - i).cast("long").alias("tf")),
        ))

    empty = F.array().cast("array<struct<term: string, tf: bigint>>")
    return let(F.sort_array(words), lambda s: F.when(F.size(s) > 0, count(s)).otherwise(empty))


def plain_tokens(text: Column, drop: Iterable[str] = ()) -> Column:
    """Lower-case words and marks in order; words in ``drop`` and single marks leave if given."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), F.lit(1))
    drop = list(drop)
    if not drop:
        return found
    return F.filter(found, lambda w: ~w.isin(drop + list(K.ASCII_PUNCTUATION)))


def clean_manufacturer(name: Column) -> Column:
    """A manufacturer's name without company forms, marks, accents and short words."""
    words = F.filter(F.split(fold(name), " "), lambda w: ~w.isin(K.COMPANY_WORDS))
    letters = F.flatten(F.transform(words, lambda w: F.split(w, "[^a-z]+")))
    return F.array_join(F.filter(letters, lambda w: F.length(w) > 2), " ")


def mentions_death(text: Column) -> Column:
    """1 when a death stem occurs anywhere in the folded text, else 0 (also for null)."""
    return F.when(fold(text).rlike("|".join(K.DEATH_STEMS)), 1).otherwise(0)


def mentions_death_word(words: Column) -> Column:
    """1 when a word of the list is one of the death words."""
    return F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in K.DEATH_WORDS])), 1).otherwise(0)


def pos_to_lemma(text: Column) -> Column:
    """Lemmas of a text written as ``lemma_POS`` words."""
    return F.transform(F.split(text, " "), lambda w: F.split(w, "_")[0])


def parse_terms(text: Column) -> Column:
    """First elements of a list of tuples written as Python text: ``[('term', 3), …]``."""
    as_json = F.translate(text, "()'", "[]\"")
    rows = F.from_json(as_json, "array<array<string>>")
    return F.transform(rows, lambda r: r[0])


def head_tail(words: Column, budget: int) -> Column:
    """First and last words within a budget; the head takes the larger half."""
    head = (budget + 1) // 2
    tail = budget - head

    def cut(w):
        ends = F.concat(F.slice(w, 1, head), F.slice(w, -tail, tail)) if tail else F.slice(w, 1, head)
        return F.when(F.size(w) <= budget, w).otherwise(ends)

    return let(words, cut)


def trim_fields(short: Column, one: Column, two: Column, budget: int = 290, limits: tuple[int, int, int] = (30, 128, 128)) -> Column:
    """Struct (short, one, two) of three word lists that fit a budget of words and four marks. The short list keeps its head; what it leaves
    goes to the long ones by halves, and what one of them leaves to the other; a long list that is still too long keeps head and tail."""
    a, b, c = limits

    def sizes(s, n, m):
        kept = F.least(s, F.lit(a))
        spare = a - kept
        most_one, most_two = b + F.ceil(spare / 2).cast("int"), c + F.floor(spare / 2).cast("int")
        first = F.when(most_two > m, most_one + most_two - m).when(most_one > n, n).otherwise(most_one)
        second = F.when(most_two > m, m).when(most_one > n, most_two + most_one - n).otherwise(most_two)
        fits = s + n + m + 4 <= budget
        return F.struct(F.when(fits, s).otherwise(kept).alias("s"), F.when(fits, n).otherwise(first).alias("n"), F.when(fits, m).otherwise(second).alias("m"))

    def ends(words, size):
        head = F.bround(size / 2).cast("int")
        tail = F.least(size - head, F.size(words))
        whole = F.concat(F.slice(words, 1, head), F.slice(words, F.size(words) - tail + 1, tail))
        return F.when(F.size(words) <= size, words).otherwise(whole)

    size = lambda w: F.greatest(F.size(w), F.lit(0))
    return let(sizes(size(short), size(one), size(two)), lambda k: F.struct(
        F.slice(short, 1, k["s"]).alias("short"), ends(one, k["n"]).alias("one"), ends(two, k["m"]).alias("two")))


def segments(short: Column, one: Column, two: Column, length: int) -> Column:
    """0 for the start mark, the short and the first long list with their end marks, 1 for the second with its mark, 0 beyond."""
    first = F.least(F.size(short) + F.size(one) + 3, F.lit(length))
    second = F.least(F.size(two) + 1, length - first)
    return F.concat(F.array_repeat(F.lit(0), first), F.array_repeat(F.lit(1), second), F.array_repeat(F.lit(0), length - first - second))


def pad_right(ids: Column, length: int, fill: int = 0) -> Column:
    return let(ids, lambda a: F.concat(
        F.slice(a, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(a)))
    ))


def pad_left(ids: Column, length: int, fill: int = 0) -> Column:
    return let(ids, lambda a: F.concat(
        F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(a))),
        F.slice(a, F.greatest(F.lit(1), F.size(a) - length + 1), F.lit(length)),
    ))


def attention_mask(ids: Column, length: int) -> Column:
    return let(F.least(F.size(ids), F.lit(length)), lambda used: F.concat(
        F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), length - used)
    ))
