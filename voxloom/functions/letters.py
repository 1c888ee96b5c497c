"""Words as an aligner's letters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.numbers import _lookup

# Symbols said, and letters said as their names.
SYMBOLS = {"%": " PERCENT", "&": " AND ", "+": " PLUS ", "@": " AT "}
NAMES = {
    "NOUGHT": "NAWT", "B": "BEE", "C": "SEE", "D": "DEE", "E": "EE", "F": "EF", "G": "JEE", "H": "AYCH", "J": "JAY", "K": "KAY",
    "L": "EL", "M": "EM", "N": "EN", "P": "PEE", "Q": "KYOO", "R": "AR", "S": "ES", "T": "TEE", "U": "YOU", "V": "VEE",
    "W": "DOUBLEYOU", "X": "EX", "Y": "WHY", "Z": "ZEE",
}
PLAIN_WORD = r"""^([A-Za-z]+)[.,!?;:"'()]*\z"""
# A character past those that no composition changes.
MAY_FOLD = r"[^\x00-\x7fÀ-ı]"
ACCENTS = {"ZEE": "ZED", "AYCH": "HAYCH"}


def _accented() -> tuple[str, str]:
    """Letters that decompose to one plain letter and marks, and that letter."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            pairs.append((chr(code), plain))
    return "".join(a for a, _b in pairs), "".join(b for _a, b in pairs)


_FROM, _TO = _accented()


def fold_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{M}", "")


def english_letters(text: Column) -> Column:
    """Symbols said, upper case, hyphens to breaks, accents folded, lone letters
    as their names. One plain word, as most are, is only put in upper case."""
    plain = F.regexp_extract(text, PLAIN_WORD, 1)
    simple, upper = (F.char_length(plain) > 1) & (F.upper(plain) != "NOUGHT"), F.upper(text)
    for symbol, said in SYMBOLS.items():
        text = F.replace(text, F.lit(symbol), F.lit(said))
    folded = fold_accents(F.upper(F.replace(text, F.lit("-"), F.lit(" "))))
    tokens = F.filter(F.split(folded, r"\s+"), lambda t: t != "")
    bare = lambda t: F.regexp_replace(t, r"""^[.,!?;:"'()]+|[.,!?;:"'()]+$""", "")
    return F.when(simple, upper).otherwise(F.array_join(F.transform(tokens, lambda t: F.coalesce(_lookup(NAMES, bare(t)), t)), " "))


def compatible(text: Column) -> Column:
    """Text in Unicode's form NFKC, by the library that Spark's collations use."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(MAY_FOLD), composed).otherwise(text)


def any_letters(word: Column) -> Column:
    """Letters, marks, apostrophes and hyphens of any script in form NFKC;
    anything else breaks the word, and its edges lose apostrophes and hyphens.
    One plain word only loses what follows it."""
    simple = F.regexp_extract(word, PLAIN_WORD, 1)
    plain = F.regexp_replace(F.translate(compatible(word), "’‘ʼ", "'''"), r"[^\p{L}\p{M}'\-]", " ")
    parts = F.transform(F.split(plain, r"\s+"), lambda p: F.regexp_replace(p, r"^['\-]+|['\-]+$", ""))
    return F.when(simple != "", simple).otherwise(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def accent_variants(said: Column) -> Column:
    """A spoken text, and, where it holds a letter's name that depends on the
    speaker, the same with the other name."""
    other = F.array_join(
        F.transform(F.split(said, " "), lambda p: F.when(p == F.upper(p), F.coalesce(_lookup(ACCENTS, p), p)).otherwise(
            F.coalesce(F.lower(_lookup(ACCENTS, F.upper(p))), p))), " ")
    return F.array_distinct(F.array(said, other))


def filter_other_alphabet(words: DataFrame, known: str = r"[A-Z]") -> DataFrame:
    """words(chunk, word, said) to (chunk, other): more than half of the words
    with letters have none that is known once said."""
    lettered = F.col("word").rlike(r"\p{L}")
    unknown = lettered & ~F.col("said").rlike(known)
    return words.groupBy("chunk").agg(
        (2 * F.count_if(unknown) > F.count_if(lettered)).alias("other")
    )
