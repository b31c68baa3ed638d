"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that count as white space when a text is stripped (a fixed value).
WHITESPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word: letters and numbers, with single apostrophes only inside (a fixed value).
WORD = "([\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*)"


def strip_ws(text: Column) -> Column:
    """text without white space at either end; unlike trim, all Unicode white space counts."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Lower-case words of a text; inner apostrophes stay, outer ones go."""
    return F.regexp_extract_all(F.lower(null_to_empty(text)), F.lit(WORD), F.lit(0))


def digits_or_zero(text: Column) -> Column:
    """The number a text of decimal digits stands for; anything else is 0."""
    return F.coalesce(F.when(text.rlike(r"^\p{Nd}+$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def to_bool(text: Column) -> Column:
    """True for "true" in any case, with white space around it; otherwise false."""
    return F.coalesce(F.lower(strip_ws(text)) == "true", F.lit(False))


def tokens_13a(text: Column) -> Column:
    """Words of the mteval-13a tokenisation."""
    out = null_to_empty(text)
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        out = F.regexp_replace(out, pattern, new)
    return F.filter(F.split(out, f"[{WHITESPACE}]+"), lambda w: w != "")


def words_chrf(text: Column) -> Column:
    """White-space words with one leading or trailing punctuation mark split off, for the word orders of chrF++."""
    mark = r"[!-/:-@\[-`{-~]"
    parts = F.filter(F.split(null_to_empty(text), f"[{WHITESPACE}]+"), lambda w: w != "")
    last, first = F.lit(f"{mark}$"), F.lit(f"^{mark}")
    split = F.transform(
        parts,
        lambda w: F.when(F.char_length(w) == 1, F.array(w))
        .when(F.regexp_like(w, last), F.array(F.substring(w, F.lit(1), F.char_length(w) - 1), F.right(w, F.lit(1))))
        .when(F.regexp_like(w, first), F.array(F.left(w, F.lit(1)), F.substring(w, F.lit(2), F.char_length(w))))
        .otherwise(F.array(w)),
    )
    return F.flatten(split)
