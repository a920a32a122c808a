"""Text analytics: words, n-grams, markup, morphology, phonetic keys, hashes."""

from __future__ import annotations

import hashlib
import hmac
import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def segment(s: Column, *separators: str) -> Column:
    """The pieces between any of the separators (between words if none is given)."""
    if not separators:
        return F.filter(F.split(s, r"\s+"), lambda x: x != "")
    return F.split(s, "|".join(re.escape(x) for x in sorted(separators, key=len, reverse=True)))


def get_words(s: Column, punctuation: bool = False) -> Column:
    """Words without the punctuation around them; with `punctuation`, its runs are words too."""
    word = r"[\p{L}\p{N}](?:[^\s\p{P}]|\p{P}(?=[\p{L}\p{N}]))*"
    return F.regexp_extract_all(s, F.lit(f"({word}|[^\\s\\p{{L}}\\p{{N}}]+)" if punctuation else f"({word})"), F.lit(1))


def fragments(words: Column, window: int = 2, affix: bool = False) -> Column:
    """Runs of 1 to `window` words; with `affix`, the list has an empty word at either end, so that runs tell where they stand."""
    w = F.concat(F.array(F.lit("")), words, F.array(F.lit(""))) if affix else words
    none = F.array().cast("array<string>")

    def runs(k: int) -> Column:
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(none)

    return F.concat(*(runs(k) for k in range(1, window + 1)))


def phrase(words: Column, start: int = 0, end: int | None = None) -> Column:
    part = F.slice(words, F.lit(start + 1), (F.lit(end) if end is not None else F.size(words)) - start) if start or end is not None else words
    return F.array_join(part, " ")


def _share(s: Column, pattern: str) -> Column:
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(F.regexp_count(s, F.lit(pattern)) / F.length(s))


def space_share(s: Column) -> Column:
    return _share(s, r"\s")


def alpha_share(s: Column) -> Column:
    return _share(s, r"\p{L}")


def alpha_length(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\p{L}"))


def count_words(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\S+"))


def markup_share(s: Column) -> Column:
    """The share of characters inside tags."""
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(1 - F.length(F.regexp_replace(s, r"<[^>]*>", "")) / F.length(s))


def disemvowel(s: Column, vowels: str = "aeiouAEIOU") -> Column:
    return F.translate(s, vowels, "")


def depunct(s: Column) -> Column:
    return F.regexp_replace(s, r"[\p{P}\s]", "")


def strip_markup(s: Column, space: bool = False) -> Column:
    return F.regexp_replace(s, r"<[^>]*>", " " if space else "")


def columnize(s: Column, widths: Sequence[int]) -> Column:
    """Fixed-width fields."""
    at, out = 1, []
    for w in widths:
        out.append(F.substring(s, at, w))
        at += w
    return F.array(*out)


def first_word(s: Column, sep: str = r"\s") -> Column:
    return F.regexp_extract(s, f"^(.*?)(?:{sep}|$)", 1)


def last_word(s: Column, sep: str = r"\s") -> Column:
    return F.element_at(F.split(s, sep), -1)


def has_word_suffix(s: Column, suffix: str, strict: bool = False) -> Column:
    """Whether the last words are these; not the whole text, if strict."""
    out = s.endswith(" " + suffix)
    return out if strict else out | (s == suffix)


def has_word_prefix(s: Column, prefix: str, strict: bool = False) -> Column:
    out = s.startswith(prefix + " ")
    return out if strict else out | (s == prefix)


def split_sep(s: Column, sep: str, escape: str = "\\") -> Column:
    """Pieces between separators that no escape character precedes."""
    return F.split(s, f"(?<!{re.escape(escape)}){re.escape(sep)}")


def find_sep(s: Column, sep: str, escape: str = "\\") -> Column:
    """Offset of the first separator that no escape character precedes; null if there is none."""
    at = F.regexp_instr(s, F.lit(f"(?<!{re.escape(escape)}){re.escape(sep)}"))
    return F.when(at > 0, at - 1)


def unslashify(s: Column) -> Column:
    """Without the backslashes that escape a character."""
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def encode_entities(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


# phonetic keys

#: Classes of letters of the soundex key; 0 stands for a vowel, which ends a run, and letters that are missing are passed over.
_SOUNDEX = {**dict.fromkeys("BFPV", "1"), **dict.fromkeys("CGJKQSXZ", "2"), **dict.fromkeys("DT", "3"), "L": "4", **dict.fromkeys("MN", "5"), "R": "6"}


def soundex_of(word: str) -> str:
    """The first letter, and three digits for the classes of the consonants that follow. A class counts again after a vowel, H and W
    don't end a run, and the first letter is compared as itself, not by its class."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).upper()
    if not plain:
        return "0000"
    key, last = plain[0], plain[0]
    for c in plain[1:]:
        if len(key) == 4:
            break
        if c in "HW":
            continue
        digit = _SOUNDEX.get(c, "")
        if digit and digit != last:
            key += digit
        last = digit
    return key.ljust(4, "0")


@F.pandas_udf(T.StringType())
def soundex(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else soundex_of(x))


def metaphone_of(word: str) -> str:
    """The key of the published Metaphone rules (Philips, 1990)."""
    w = "".join(c for c in unicodedata.normalize("NFD", word).upper() if "A" <= c <= "Z")
    for a, b in (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("WH", "W"), ("X", "S")):
        if w.startswith(a):
            w = b + w[len(a) :]
            break
    out, n = [], len(w)
    at = lambda i: w[i] if 0 <= i < n else ""
    i = 0
    while i < n:
        c, skip = w[i], 1
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if i == n - 1 and at(i - 1) == "M" else "B"
        elif c == "C":
            if w[i : i + 3] == "CIA" or (at(i + 1) == "H" and at(i - 1) != "S"):
                code, skip = "X", 2 if at(i + 1) == "H" else 1
            elif at(i + 1) in ("I", "E", "Y") and at(i + 1):
                code = "" if at(i - 1) == "S" else "S"
            else:
                code, skip = "K", 2 if at(i + 1) == "H" else 1
        elif c == "D":
            code = "J" if at(i + 1) == "G" and at(i + 2) in ("E", "Y", "I") and at(i + 2) else "T"
        elif c == "G":
            if at(i + 1) == "H" and not (i + 2 >= n or at(i + 2) in "AEIOU"):
                code = ""
            elif (at(i + 1) == "N" and (i + 2 >= n or w[i + 1 :] == "NED")) or (at(i - 1) == "D" and at(i + 1) in ("E", "Y", "I") and at(i + 1)):
                code = ""
            else:
                code = "J" if at(i + 1) in ("I", "E", "Y") and at(i + 1) and at(i - 1) != "G" else "K"
        elif c == "H":
            code = "H" if at(i + 1) in ("A", "E", "I", "O", "U") and at(i - 1) not in ("C", "S", "P", "T", "G") else ""
        elif c == "K":
            code = "" if at(i - 1) == "C" else "K"
        elif c == "P":
            code = "F" if at(i + 1) == "H" else "P"
        elif c == "Q":
            code = "K"
        elif c == "S":
            code = "X" if at(i + 1) == "H" or w[i : i + 3] in ("SIO", "SIA") else "S"
        elif c == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                code = "X"
            elif at(i + 1) == "H":
                code = "0"
            else:
                code = "" if w[i : i + 3] == "TCH" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if at(i + 1) in ("A", "E", "I", "O", "U") else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        else:
            code = c
        out.append(code)
        i += skip
    return "".join(out)


@F.pandas_udf(T.StringType())
def metaphone(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else metaphone_of(x))


# stemming, by the published rules (Porter, 1980)


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub("v+", "v", re.sub("c+", "c", _kinds(stem)))))


def _kinds(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _short(w: str) -> bool:
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter_of(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif (s := _longest(w, ("ed", "ing"))) and "v" in _kinds(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if s := _longest(w, _STEP4):
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def porter_stem(s: pd.Series) -> pd.Series:
    known: dict = {None: None}
    return s.map(lambda x: known.get(x) or known.setdefault(x, porter_of(x)) if x is not None else None)


def morph_rules(words: DataFrame, word: str, rules: Sequence[tuple[str, str]], lexicon: DataFrame, entry: str) -> DataFrame:
    """Words with the `root` forms that the suffix rules (old, new) give and the lexicon knows, the word itself first; null if none."""
    tries = [F.struct(F.lit(0).alias("place"), F.col(word).alias("form"))]
    for k, (old, new) in enumerate(rules):
        tries.append(F.when(F.col(word).endswith(old), F.struct(F.lit(k + 1).alias("place"), F.concat(F.substring(F.col(word), F.lit(1), F.length(word) - len(old)), F.lit(new)).alias("form"))))
    each = words.select(word).distinct().select(word, F.explode(F.array_compact(F.array(*tries))).alias("t"))
    known = each.join(lexicon.select(F.col(entry).alias("__e")).distinct(), F.col("t.form") == F.col("__e"))
    best = known.groupBy(F.col(word).alias("__w")).agg(F.min("t").alias("t"))
    return words.join(best, F.col(word) == F.col("__w"), "left").withColumn("root", F.col("t.form")).drop("__w", "t")


# hashes


def md5(c: Column) -> Column:
    return F.unhex(F.md5(c))


def sha1(c: Column) -> Column:
    return F.unhex(F.sha1(c))


def sha2(c: Column, bits: int) -> Column:
    return F.unhex(F.sha2(c, bits))


def hmac_digest(key: bytes, kind: str):
    """A function of a text column: its HMAC under the key, by sha1, sha256, sha384 or sha512."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key, x.encode() if isinstance(x, str) else bytes(x), getattr(hashlib, kind)).digest())

    return run
