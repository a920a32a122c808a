"""String functions as column expressions. Python is used only where SQL has no form: folding of diacritics and phrase case."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(test: str) -> str:
    return rf"^{test}+$"


def is_alphabetic(c: Column) -> Column:
    return c.rlike(_each(r"\p{L}"))


def is_numeric(c: Column) -> Column:
    return c.rlike(_each(r"\p{Nd}"))


def is_whitespace(c: Column) -> Column:
    return c.rlike(_each(r"[\s\p{Z}]"))


def is_alphanumeric(c: Column) -> Column:
    return c.rlike(_each(r"[\p{L}\p{N}]"))


def is_punctuation(c: Column) -> Column:
    return c.rlike(_each(r"\p{P}"))


def is_ascii(s: Column) -> Column:
    return s.rlike(r"(?s)^[\x00-\x7F]*$")


def is_latin1(s: Column) -> Column:
    return s.rlike(r"(?s)^[\x00-\xFF]*$")


def is_lowercase(s: Column) -> Column:
    """No upper-case letter."""
    return ~s.rlike(r"\p{Lu}")


def is_uppercase(s: Column) -> Column:
    """No lower-case letter."""
    return ~s.rlike(r"\p{Ll}")


def is_capitalized(s: Column) -> Column:
    return s.rlike(r"^\p{Lu}")


def some_capital(s: Column, window: int | None = None) -> Column:
    """An upper-case letter, among the first `window` characters if given."""
    return (F.substring(s, 1, window) if window else s).rlike(r"\p{Lu}")


def is_empty(s: Column, spaces: bool = False) -> Column:
    return F.length(F.regexp_replace(s, r"[\s\p{Z}]", "") if spaces else s) == 0


def is_compound(s: Column) -> Column:
    return s.rlike(r"\S\s+\S")


def is_multiline(s: Column) -> Column:
    return s.rlike(r"[\n\r]")


def phrase_length(s: Column) -> Column:
    """Words, by white space."""
    return F.regexp_count(s, F.lit(r"\S+"))


def char_to_integer(c: Column) -> Column:
    """The code point of the first character."""
    return F.conv(F.hex(F.encode(F.substring(c, 1, 1), "UTF-32")), 16, 10).cast("int")


def integer_to_char(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")


def capitalize(s: Column) -> Column:
    """Each word with a capital and the rest in lower case; any white space ends a word, and is kept."""
    words = F.regexp_extract_all(s, F.lit(r"(\s+|\S+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def capitalize_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def std_space(s: Column, keep_vertical: bool = False) -> Column:
    """Runs of white space as one space, none at the ends; with keep_vertical, runs with an empty line in them as one."""
    if keep_vertical:
        s = F.regexp_replace(s, r"[^\S\n]*\n[^\S\n]*\n\s*", "\u0000")
        return F.replace(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ \u0000]+|[ \u0000]+$", ""), F.lit("\u0000"), F.lit("\n\n"))
    return F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " "))


#: Signs that std_punct() folds, and what they become (fixed values).
PUNCT_FROM, PUNCT_TO = "‘’‚‛′“”„‟″‐‑‒–", "'''''\"\"\"\"\"----"


def std_punct(s: Column) -> Column:
    """Typographic quotes and dashes as ASCII; a long dash is two."""
    return F.replace(F.translate(s, PUNCT_FROM, PUNCT_TO), F.lit("—"), F.lit("--"))


@F.pandas_udf(T.StringType())
def base_string(s: pd.Series) -> pd.Series:
    """Without diacritics."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def std_string(s: Column) -> Column:
    return F.lower(base_string(std_space(s)))


@F.pandas_udf(T.StringType())
def std_cap(s: pd.Series) -> pd.Series:
    """A phrase in which some word has a capital, with one for each of its all lower-case words; others as they are."""

    def one(x):
        if x is None or not any(w[:1].isupper() for w in x.split()):
            return x
        return " ".join(w if not w.islower() else w[:1].upper() + w[1:] for w in x.split(" "))

    return s.map(one)


def start_word(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*(\S*)", 1)


def indent(s: Column, pad: str = "    ") -> Column:
    return F.regexp_replace(s, r"(?m)^(?=.)", pad)


def ngrams(s: Column, n: int) -> Column:
    """The set of character n-grams of a text in lower case without diacritics, with a blank at either end."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            padded = f" {''.join(c for c in unicodedata.normalize('NFD', x) if not unicodedata.combining(c)).lower()} "
            return sorted({padded[i : i + n] for i in range(len(padded) - n + 1)})

        return texts.map(one)

    return run(s)


def bigrams(s: Column) -> Column:
    return ngrams(s, 2)


def trigrams(s: Column) -> Column:
    return ngrams(s, 3)


def has_suffix(s: Column, *affixes: str) -> Column:
    """Whether any of the affixes ends it."""
    out = F.lit(False)
    for a in affixes:
        out = out | s.endswith(a)
    return out


def has_prefix(s: Column, *affixes: str) -> Column:
    out = F.lit(False)
    for a in affixes:
        out = out | s.startswith(a)
    return out


def _by_length(affixes: Sequence[str]) -> list[str]:
    return sorted(affixes, key=lambda a: (-len(a), a))


def strip_suffix(s: Column, *affixes: str) -> Column:
    """Without the longest of the affixes that ends it."""
    out = s
    for a in reversed(_by_length(affixes)):
        out = F.when(s.endswith(a), F.substring(s, F.lit(1), F.length(s) - len(a))).otherwise(out)
    return out


def strip_prefix(s: Column, *affixes: str) -> Column:
    out = s
    for a in reversed(_by_length(affixes)):
        out = F.when(s.startswith(a), F.substring(s, F.lit(len(a) + 1), F.length(s))).otherwise(out)
    return out


#: Words that say yes and no (fixed values).
YES, NO = ("yes", "y", "true", "t", "on", "1", "ok", "sure"), ("no", "n", "false", "f", "off", "0", "nope", "never")


def is_yes(s: Column, default: bool = False) -> Column:
    word = F.lower(F.trim(s))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False).otherwise(default)


def subst(s: Column, old: str, new: str, *more: str) -> Column:
    """Replaces literal text; further pairs are replaced in turn."""
    pairs = (old, new, *more)
    for a, b in zip(pairs[::2], pairs[1::2]):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def fix_nuls(s: Column) -> Column:
    return F.replace(s, F.lit("\u0000"), F.lit("�"))


def glom(*parts: Column) -> Column:
    return F.concat(*parts)


def compare_chain(op: str, *parts: Column, ignore_case: bool = False) -> Column:
    """Whether each part stands in the relation to the next: =, !=, <, <=, >, >=."""
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if ignore_case:
        parts = tuple(F.lower(p) for p in parts)
    out = F.lit(True)
    for a, b in zip(parts, parts[1:]):
        out = out & ops[op](a, b)
    return out


def downcase(s: Column) -> Column:
    return F.lower(s)


def upcase(s: Column) -> Column:
    return F.upper(s)


def trim_spaces(s: Column) -> Column:
    """Without the white space at its ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def make_string(n: int, c: str = " ") -> Column:
    return F.repeat(F.lit(c), n)


def subst_all(s: Column, *pairs: str) -> Column:
    """Several literal replacements, one after the other: old, new, old, new."""
    for old, new in zip(pairs[::2], pairs[1::2]):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def matches_some(s: Column, *patterns: object) -> Column:
    """Whether a text equals one of some texts, or one of some patterns (see regexes.Regex) is found in it."""
    tests = [(s == F.lit(p)) if isinstance(p, str) else p(s) for p in patterns]
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False))


def text_if(test: Column, *parts: Column) -> Column:
    """The parts joined if the test holds, else an empty text."""
    return F.when(test, F.concat(*parts)).otherwise("")


def to_packet(s: Column, encoding: str = "UTF-8") -> Column:
    return F.encode(s, encoding)


def from_packet(b: Column, encoding: str = "UTF-8") -> Column:
    return F.decode(b, encoding)


def is_utf8(b: Column) -> Column:
    """Whether bytes are valid UTF-8."""
    return F.is_valid_utf8(b.cast("string"))
