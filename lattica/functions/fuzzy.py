"""Fuzzy index keys: the forms under which a term, phrase or text may be looked for.

A key is a text with a kind before it: `t:` a form of the term itself, `b:` without diacritics, `s:` its stem, `m:` metaphone, `x:`
soundex, `f:` a fragment of a phrase; kinds keep a stem from being taken for a word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import strings, text
from lattica.plans.storage import written


def _keys_of(term: str, phonetic: bool, stem: bool, fragments: int) -> set[str]:
    import unicodedata

    plain = " ".join(term.split())
    if not plain:
        return set()
    forms = {plain, plain.lower()}
    if any(c.isupper() for c in plain):
        forms.add(" ".join(w[:1].upper() + w[1:].lower() for w in plain.split(" ")))
    fold = str.maketrans(dict(zip(strings.PUNCT_FROM, strings.PUNCT_TO)))
    forms |= {f.translate(fold).replace("—", "--") for f in forms}
    bases = {"".join(c for c in unicodedata.normalize("NFD", f) if not unicodedata.combining(c)) for f in forms}
    keys = {"t:" + f for f in forms} | {"b:" + b for b in bases - forms}
    keys |= {"t:" + f.replace("-", r) for f in forms if "-" in f for r in (" ", "")}
    if phonetic:
        keys |= {"m:" + text.metaphone_of(f) for f in forms} | {"x:" + text.soundex_of(f) for f in forms}
    if stem:
        keys |= {"s:" + text.porter_of(f) for f in forms}
    if fragments:
        for f in forms | bases:
            parts = f.replace("-", " ").split(" ")
            if len(parts) > 1:
                keys |= {"f:" + " ".join(parts[i : i + n]) for n in range(1, fragments + 1) for i in range(len(parts) - n + 1)}
                if stem:
                    stems = [text.porter_of(p) for p in parts]
                    keys |= {"s:" + " ".join(stems[i : i + n]) for n in range(1, fragments + 1) for i in range(len(stems) - n + 1)}
    return keys


def fuzz_terms(terms: DataFrame, term: str, phonetic: bool = True, stem: bool = True, fragments: int = 1) -> DataFrame:
    """terms with a sorted set of `keys`, computed once for each batch's different terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = {t: sorted(_keys_of(t, phonetic, stem, fragments)) for t in b["__t"].dropna().unique()}
            yield pd.DataFrame({"__t": list(known), "keys": list(known.values())})

    each = terms.select(F.col(term).alias("__t")).distinct().mapInPandas(run, "__t string, keys array<string>")
    return terms.join(each, F.col(term) == F.col("__t"), "left").drop("__t").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def fuzz_strings(s: Column, separators: Sequence[str] = ()) -> Column:
    """The keys of a text as a name: white space, case and signs made alike, and the parts between separators."""
    plain = strings.std_space(s)
    forms = F.array(plain, F.lower(plain), F.when(strings.some_capital(plain), strings.capitalize(plain)), strings.std_punct(plain), strings.std_punct(F.lower(plain)))
    keys = F.transform(F.array_compact(forms), lambda f: F.concat(F.lit("t:"), f))
    if separators:
        keys = F.concat(keys, F.transform(text.segment(F.lower(plain), *separators), lambda f: F.concat(F.lit("f:"), F.trim(f))))
    return F.array_sort(F.array_distinct(keys))


def text_terms(s: Column, stopwords: Sequence[str] = (), longest: int = 16) -> Column:
    """The words of a text that are indexed: no stop words, more than two and fewer than `longest` characters."""
    w = F.array_distinct(text.get_words(s))
    if stopwords:
        w = F.array_except(w, F.array(*(F.lit(x) for x in stopwords)))
    return F.array_sort(F.filter(w, lambda x: (F.length(x) > 2) & (F.length(x) < longest)))


def index_text(docs: DataFrame, key: str, column: str, stopwords: Sequence[str] = (), phonetic: bool = False, stem: bool = True) -> DataFrame:
    """The fuzzy postings of a text column: oid, fuzzy key. The texts are split once, and the words written; keys are computed once
    per word of the corpus, and joined to the words' documents. The keys of words that very many documents have are broadcast, so
    that no task of the join gets all their rows."""
    words = written(docs.select(F.col(key).alias("oid"), F.explode(text_terms(F.col(column), stopwords)).alias("word")), "words")
    each = words.groupBy("word").agg(F.count("*").alias("docs"))
    keyed = written(fuzz_terms(each, "word", phonetic, stem, 0).select("word", "docs", F.explode("keys").alias("key")), "word-keys")
    many = max(1000, words.count() // 20_000)  # 20,000 words at most have so many documents
    hot = F.broadcast(keyed.where(F.col("docs") >= many).select("word", "key"))
    rest = words.join(hot.select("word").distinct(), "word", "left_anti").join(keyed.where(F.col("docs") < many).select("word", "key"), "word")
    return words.join(hot, "word").unionByName(rest).select("oid", "key").distinct()


def fuzzy_find(postings: DataFrame, *keys: str) -> DataFrame:
    """Frames under any of the keys, with how many of them they are under."""
    return postings.where(F.col("key").isin(list(keys))).groupBy("oid").agg(F.countDistinct("key").alias("hits"))
