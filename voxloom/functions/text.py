"""Text rules as native expressions. Letters, digits and the underscore make a
word in any script; the classes are spelled out because a bare \\w is ASCII
only here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.arrays import let

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"
MARKER = "▁"
_DOTLESS = "\ue000"  # stands for a dotless i while case is folded

# Full stops that end no sentence before a number.
ABBREVIATIONS = (
    "no.", "nos.", "mr.", "mrs.", "ms.", "dr.", "st.", "vs.", "e.g.", "i.e.", "approx.", "fig.", "vol.", "p.",
)
OPENING_MARKS = "\"'([“‘"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """Markers to spaces, trimmed, whitespace collapsed, and a currency sign
    set apart from the letter before it."""
    spaced = strip(F.regexp_replace(text, MARKER, " "))
    return F.coalesce(
        F.regexp_replace(F.regexp_replace(spaced, rf"{SPACE}+", " "), r"(?<=\p{L})(?=[$£€])", " "), F.lit("")
    )


def decode_tokens(tokens: Column) -> Column:
    """The text tokens spell: the leading space goes, and any space before a
    mark other than an apostrophe."""
    joined = F.regexp_replace(F.array_join(tokens, ""), MARKER, " ")
    unled = F.regexp_replace(joined, rf"^{SPACE}", "")
    return F.regexp_replace(F.regexp_replace(unled, rf"{SPACE}(?![\p{{L}}\p{{N}}_'])", ""), SPACE, " ")


def case_folded(text: Column) -> Column:
    """Full case folding: lower case of upper case, which opens ligatures and
    sharp s, with one sigma, and a dotless i that stays one."""
    kept = F.replace(text, F.lit("ı"), F.lit(_DOTLESS))
    # the capital sharp s goes between the two, which Catalyst would else make one
    folded = F.replace(F.lower(F.replace(F.upper(kept), F.lit("ẞ"), F.lit("SS"))), F.lit("ς"), F.lit("σ"))
    return F.replace(folded, F.lit(_DOTLESS), F.lit("ı"))


def seam_key(word: Column) -> Column:
    """How two decodes of a word compare: word characters only, case folded."""
    return case_folded(F.regexp_replace(word, NOT_WORD, ""))


def has_word_character(token: Column) -> Column:
    return token.rlike(WORD)


def is_sentence_start(previous: Column) -> Column:
    """Whether a word after `previous` opens a sentence; null is no word before."""
    bare = F.regexp_replace(F.lower(previous), r"""^["'(\[“‘]+""", "")
    ends = previous.rlike(r"""[.!?]["')\]”’]*$""")
    return previous.isNull() | (ends & ~bare.isin(*ABBREVIATIONS))


def capitalise(text: Column) -> Column:
    """The first letter upper-cased, past anything before it."""
    head = F.regexp_extract(text, r"^[^\p{L}]*", 0)
    return let(
        F.char_length(head),
        lambda n: F.concat(head, F.upper(F.substring(text, n + 1, F.lit(1))), F.substring(text, n + 2, F.char_length(text))),
    )


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded to the millisecond (halves to even)."""
    return let(
        F.greatest(F.bround(seconds * 1000, 0).cast("long"), F.lit(0).cast("long")),
        lambda ms: F.format_string(
            "%02d:%02d:%02d,%03d",
            F.call_function("div", ms, F.lit(3600000).cast("long")),
            F.call_function("div", ms, F.lit(60000).cast("long")) % 60,
            F.call_function("div", ms, F.lit(1000).cast("long")) % 60,
            ms % 1000,
        ),
    )
