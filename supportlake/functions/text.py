"""Text expressions, all native Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake.functions.rules import WORD

SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
HANDLE = f"@[{WORD}]+"
URL = f"https?://[^{SPACE}]+"
TOKEN = f"[{WORD}]{{2,}}"


def nvl(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def clean_text(text: Column) -> Column:
    """Drop handles and links, collapse white space, trim."""
    bare = F.regexp_replace(F.regexp_replace(nvl(text), HANDLE, ""), URL, "")
    return F.trim(F.regexp_replace(bare, f"[{SPACE}]+", " "))


def strip_handles(text: Column) -> Column:
    return strip(F.regexp_replace(strip(nvl(text)), HANDLE, ""))


def preview(text: Column, n: int) -> Column:
    """First n characters on one line, for display columns."""
    return F.substring(F.translate(nvl(text), "\n", " "), 1, n)


def is_ascii(text: Column) -> Column:
    return ~nvl(text).rlike(r"[^\x00-\x7F]")


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased runs of at least two word characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(nvl(text)), F.lit(TOKEN), F.lit(0))
    if stop_words:
        found = F.filter(found, lambda t: ~t.isin(list(stop_words)))
    return found


def ngrams(column: str, low: int, high: int) -> Column:
    """All word n-grams of a token array column for n in [low, high], joined by a blank.

    Takes a column name, not an expression: the array is read once per position and must not
    be computed anew each time.
    """
    toks = F.col(column)

    def grams(n: int) -> Column:
        if n == 1:
            return toks
        starts = F.sequence(F.lit(0), F.size(toks) - n)
        joined = F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(toks, i + j) for j in range(n)])
        )
        return F.when(F.size(toks) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[grams(n) for n in range(low, high + 1)]))


def language_words(text: Column) -> Column:
    """Words of a message once handles, links and punctuation are gone."""
    bare = F.regexp_replace(F.regexp_replace(nvl(text), HANDLE, ""), URL, "")
    bare = F.regexp_replace(bare, f"[^{WORD}{SPACE}]", " ")
    return F.filter(F.split(F.lower(bare), f"[{SPACE}]+"), lambda w: w != "")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
