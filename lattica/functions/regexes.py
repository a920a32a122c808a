"""Regular expressions as values, and as tests of values. Patterns are Java's; of several alternatives the first one that fits is taken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Regex:
    """A pattern; nocase: letters of either case are alike; lines: ^ and $ stand for the ends of lines too."""

    pattern: str
    nocase: bool = False
    lines: bool = False

    @property
    def text(self) -> Column:
        flags = "i" * self.nocase + "m" * self.lines
        return F.lit(f"(?{flags}){self.pattern}" if flags else self.pattern)

    def __call__(self, s: Column) -> Column:
        """Whether the pattern is found anywhere, as pick and reject test it."""
        return F.coalesce(F.rlike(s, self.text), F.lit(False))


def search(rx: Regex, s: Column) -> Column:
    """Offset of the first place where it is found, null if there is none."""
    at = F.regexp_instr(s, rx.text)
    return F.when(at > 0, at - 1)


def match_string(rx: Regex, s: Column) -> Column:
    """What is found first, null if nothing is."""
    return F.regexp_substr(s, rx.text)


def match_span(rx: Regex, s: Column) -> Column:
    """Where the first match starts and ends."""
    at = search(rx, s)
    return F.when(at.isNotNull(), F.struct(at.alias("start"), (at + F.length(match_string(rx, s))).alias("end")))


def match_length(rx: Regex, s: Column) -> Column:
    """The length of the first match if the text begins with it, else null."""
    return F.when(search(rx, s) == 0, F.length(match_string(rx, s)))


def match(rx: Regex, s: Column) -> Column:
    """Whether the first match is the whole text."""
    return F.coalesce(match_string(rx, s) == s, F.lit(False))


def gather(rx: Regex, s: Column) -> Column:
    """The set of all that is found, without overlaps."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(s, rx.text, F.lit(0))))
