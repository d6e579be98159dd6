"""Rule packs as data, compiled to one regular expression per rule.

A rule is a list of alternatives. An alternative matches where it is bounded the way `\\b`
bounds it, with Unicode letters and digits as word characters. The classes are spelled out
because `\\b` and `\\w` differ between regex engines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"


@dataclass(frozen=True)
class RulePack:
    """Named rules over one vocabulary.

    `intents` keeps taxonomy order, `priority` decides between several matches, `fallback`
    takes the texts no intent matches. `topics` and `keywords` are first-match lists.
    """

    name: str
    flags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    intents: dict[str, tuple[str, ...]] = field(default_factory=dict)
    priority: tuple[str, ...] = ()
    fallback: str = "other"
    topics: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    common_words: tuple[str, ...] = ()

    def intent_order(self) -> tuple[str, ...]:
        return self.priority or tuple(self.intents)


def _ends_in_word(alternative: str) -> bool:
    """Whether the last matched character is a word character (so none may follow)."""
    return alternative.endswith((r"\w+", ")")) or alternative[-1].isalnum()


def _expand(alternative: str) -> str:
    return alternative.replace(r"\w", f"[{WORD}]")


def _split(alternatives: Sequence[str]) -> tuple[list[str], list[str]]:
    closed = [_expand(a) for a in alternatives if _ends_in_word(a)]
    open_ = [_expand(a) for a in alternatives if not _ends_in_word(a)]
    return closed, open_


def java_regex(alternatives: Sequence[str]) -> str:
    """Pattern for Spark. An alternative ending in punctuation needs a word character after it."""
    closed, open_ = _split(alternatives)
    parts = []
    if closed:
        parts.append(f"(?:{'|'.join(closed)})(?![{WORD}])")
    if open_:
        parts.append(f"(?:{'|'.join(open_)})(?=[{WORD}])")
    return f"(?iu)(?<![{WORD}])(?:{'|'.join(parts)})"


def re2_regex(alternatives: Sequence[str]) -> str:
    """The same rule without look-around, for engines that have none."""
    closed, open_ = _split(alternatives)
    parts = []
    if closed:
        parts.append(f"(?:{'|'.join(closed)})(?:$|[^{WORD}])")
    if open_:
        parts.append(f"(?:{'|'.join(open_)})[{WORD}]")
    return f"(?i)(?:^|[^{WORD}])(?:{'|'.join(parts)})"


def matches(text: Column, alternatives: Sequence[str]) -> Column:
    """Rule test; null text counts as empty."""
    if not alternatives:
        return F.lit(False)
    return F.coalesce(text, F.lit("")).rlike(java_regex(alternatives))


def contains_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Unbounded search for any pattern in the lower-cased text."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(f"(?:{p})" for p in patterns))


def first_match(text: Column, rules: dict[str, Sequence[str]], default: str) -> Column:
    """Label of the first rule, in order, that matches."""
    hits = [F.when(matches(text, alts), F.lit(label)) for label, alts in rules.items()]
    return F.coalesce(*hits, F.lit(default))
