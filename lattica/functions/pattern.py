"""A pattern language, compiled to Java regular expressions.

A pattern is a text (itself), a list (a sequence), a set (alternatives, the longest first), or a tuple whose first item names an
operator: ("*", p), ("opt", p), ("label", "name", p), ("isdigit+",), ("chars", "abc"), ("char-range", "a", "z"), ..."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes; each is also there with a + for a run (fixed values).
CLASSES = {
    "isvowel": "[aeiouAEIOUàáâäåèéêëìíîïòóôöùúûüÀÁÂÄÅÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ]",
    "isnotvowel": "[^aeiouAEIOUàáâäåèéêëìíîïòóôöùúûüÀÁÂÄÅÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ]",
    "isspace": r"[\s\p{Z}]",
    "hspace": r"\h",
    "vspace": r"\v",
    "isascii": r"\p{ASCII}",
    "notascii": r"\P{ASCII}",
    "isalnum": r"[\p{L}\p{N}]",
    "isword": r"[\p{L}'-]",
    "isalpha": r"\p{L}",
    "isdigit": r"\p{Nd}",
    "isprint": r"[^\p{Cntrl}]",
    "isxdigit": "[0-9a-fA-F]",
    "isodigit": "[0-7]",
    "ispunct": r"\p{P}",
    "iscntrl": r"\p{Cntrl}",
    "isupper": r"\p{Lu}",
    "islower": r"\p{Ll}",
    "isnotupper": r"\P{Lu}",
    "isnotlower": r"\P{Ll}",
}
#: Patterns without arguments (fixed values).
ATOMS = {
    "bol": "(?m:^)",
    "eol": "(?m:$)",
    "bos": r"\A",
    "eos": r"\z",
    "bow": r"\b(?=[\p{L}\p{N}])",
    "eow": r"\b(?<=[\p{L}\p{N}])",
    "spaces": r"[\s\p{Z}]+",
    "spaces*": r"[\s\p{Z}]*",
    "vbreak": r"\h*\v\h*\v\s*",
    "lsymbol": r"[^\s()\[\]{}\"';,`|]+",
    "csymbol": r"[A-Za-z_][A-Za-z0-9_]*",
    "pathelt": r"[\w.-]+",
    "xmlname": r"[\p{L}_:][\w:.-]*",
    "xmlnmtoken": r"[\w:.-]+",
    "htmlid": r"[A-Za-z][\w-]*",
    "aword": r"[A-Za-z]\w*",
    "lword": r"\p{Ll}+",
    "anumber": r"[+-]?\d+(?:\.\d+)?",
    "capword": r"\p{Lu}[\p{L}\p{N}'-]*",
    "compound-word": r"[\p{L}\p{N}]+(?:[-.'][\p{L}\p{N}]+)*",
    "mailid": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "rest": "(?s:.*)",
}


@dataclass
class Compiled:
    """A regular expression, the names of its labels in order of their groups, and replacements of its subst parts by group."""

    regex: str
    labels: list[str] = field(default_factory=list)
    substs: dict[str, str] = field(default_factory=dict)


def _group(text: str) -> str:
    return f"(?:{text})"


def _class(chars: str) -> str:
    return "".join("\\" + c if c in r"\[]^-&" else c for c in chars)


class _Compiler:
    def __init__(self) -> None:
        self.labels: list[str] = []
        self.substs: dict[str, str] = {}

    def literal(self, text: str, spacing: bool) -> str:
        out = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
        return re.sub(r"\s+", lambda _: r"[\\s\\p{Z}]+".replace("\\\\", "\\"), out) if spacing else out

    def run(self, p, spacing: bool = False) -> str:
        if isinstance(p, str):
            return self.literal(p, spacing)
        if isinstance(p, list):
            return "".join(self.run(x, spacing) for x in p)
        if isinstance(p, (set, frozenset)):
            return self.alternatives(sorted(p, key=lambda x: (-len(str(x)), str(x))), spacing)
        name, *args = p
        name = name.lower()
        one = lambda: _group("".join(self.run(a, spacing) for a in args))
        if name in ATOMS:
            return ATOMS[name]
        if name in CLASSES:
            return CLASSES[name]
        if name.endswith("+") and name[:-1] in CLASSES:
            return CLASSES[name[:-1]] + "+"
        if name in ("*", "+"):
            return one() + name
        if name == "opt":
            return one() + "?"
        if name in ("choice", "pref"):
            return self.alternatives(args, spacing)
        if name in ("longest", "expansive"):
            return self.alternatives(sorted(args, key=lambda x: (-len(str(x)), str(x))), spacing)
        if name == "not":
            return f"(?:(?!{one()}).)*"
        if name == "not>":
            return f"(?s:(?:(?!{one()}).)*)"
        if name == "and":
            *first, last = args
            return "".join(f"(?={self.run(a, spacing)})" for a in first) + self.run(last, spacing)
        if name == "greedy":
            return f"(?>{one()})"
        if name in ("label", "="):
            label = re.sub(r"[^A-Za-z0-9]", "", args[0])
            self.labels.append(args[0])
            return f"(?<{label}>{''.join(self.run(a, spacing) for a in args[1:])})"
        if name == "subst":
            label = f"subst{len(self.substs)}"
            self.labels.append(label)
            self.substs[label] = args[1]
            return f"(?<{label}>{self.run(args[0], spacing)})"
        if name in ("match-case", "mc"):
            return f"(?-i:{one()})"
        if name in ("ignore-case", "ic"):
            return f"(?iu:{one()})"
        if name in ("ignore-spacing", "is"):
            return _group("".join(self.run(a, True) for a in args))
        if name in ("match-spacing", "ms"):
            return _group("".join(self.run(a, False) for a in args))
        if name in ("ignore-diacritics", "id"):
            return _group("".join(self.run(a, spacing) + r"\p{M}*" if isinstance(a, str) and len(a) == 1 else self.run(a, spacing) for a in args))
        if name in ("match-diacritics", "md"):
            return one()
        if name == "canonical":
            return f"(?iu:{''.join(self.run(a, True) for a in args)})"
        if name == "char-range":
            return f"[{_class(args[0])}-{_class(args[1])}]"
        if name in ("chars", "chars*"):
            return f"[{_class(''.join(args))}]" + name[5:]
        if name in ("char-not", "char-not*"):
            return f"[^{_class(''.join(args))}]" + name[8:]
        if name in ("word", "phrase"):
            return rf"(?<![\p{{L}}\p{{N}}]){''.join(self.run(a, spacing or name == 'phrase') for a in args)}(?![\p{{L}}\p{{N}}])"
        if name == "chunk":
            return one()
        if name == "minlen":
            return f"(?=(?s:.{{{args[1]},}})){self.run(args[0], spacing)}" if not isinstance(args[0], tuple) or args[0][0] not in CLASSES else f"{self.run(args[0])}{{{args[1]},}}"
        if name == "maxlen":
            return f"{self.run(args[0], spacing)}{{0,{args[1]}}}" if isinstance(args[0], tuple) and args[0][0] in CLASSES else self.run(args[0], spacing)
        if name in ("hashset", "hashset-not"):
            members = "|".join(self.literal(x, spacing) for x in sorted(args[0], key=lambda x: (-len(x), x)))
            token = r"[\p{L}\p{N}'-]+"
            return f"(?={token})(?:{members})(?![\\p{{L}}\\p{{N}}])" if name == "hashset" else f"(?!(?:{members})(?![\\p{{L}}\\p{{N}}])){token}"
        raise ValueError(f"no pattern operator is named {name}")

    def alternatives(self, items, spacing: bool) -> str:
        return _group("|".join(self.run(x, spacing) for x in items))


def compile_pattern(pattern) -> Compiled:
    c = _Compiler()
    return Compiled(c.run(pattern), c.labels, c.substs)


def regex_of(pattern) -> str:
    return compile_pattern(pattern).regex


def matches(s: Column, pattern) -> Column:
    """Whether the whole text matches."""
    return s.rlike(rf"\A(?:{regex_of(pattern)})\z")


def contains(s: Column, pattern) -> Column:
    return s.rlike(regex_of(pattern))


def starts_with(s: Column, pattern) -> Column:
    return s.rlike(rf"\A(?:{regex_of(pattern)})")


def ends_with(s: Column, pattern) -> Column:
    return s.rlike(rf"(?:{regex_of(pattern)})\z")


def match_length(s: Column, pattern) -> Column:
    """How much matches from the start on; null if nothing does."""
    r = rf"\A(?:{regex_of(pattern)})"
    return F.when(s.rlike(r), F.length(F.regexp_substr(s, F.lit(r))))


def search(s: Column, pattern) -> Column:
    """Offset of the first match, null if there is none."""
    at = F.regexp_instr(s, F.lit(regex_of(pattern)))
    return F.when(at > 0, at - 1)


def gather_list(s: Column, pattern) -> Column:
    """All matches in order, with repeats."""
    return F.regexp_extract_all(s, F.lit(f"({regex_of(pattern)})"), F.lit(1))


def gather(s: Column, pattern) -> Column:
    """The set of all matches."""
    return F.array_sort(F.array_distinct(gather_list(s, pattern)))


def subst(s: Column, pattern, replacement: str) -> Column:
    return F.regexp_replace(s, regex_of(pattern), re.sub(r"([\\$])", r"\\\1", replacement))


def rewrite(s: Column, pattern) -> Column:
    """The text with the parts of each match that subst marks replaced."""
    c = compile_pattern(pattern)
    out = s
    if not c.substs:
        return out
    # what stands before, between and after the replaced parts is kept by a group of its own
    def split(p) -> list:
        return p if isinstance(p, list) else [p]

    pieces, template = [], []
    for x in split(pattern):
        if isinstance(x, tuple) and x[0].lower() == "subst":
            pieces.append(_group(regex_of(x[1])))
            template.append(re.sub(r"([\\$])", r"\\\1", x[2]))
        else:
            pieces.append(f"({re.sub(r'[(][?]<[A-Za-z0-9]+>', '(?:', regex_of(x))})")
            template.append(f"${len([1 for q in pieces if q.startswith('(') and not q.startswith('(?')])}")
    return F.regexp_replace(out, "".join(pieces), "".join(template))


def get_frame(s: Column, pattern) -> Column:
    """The labels of the first match, as a struct; null where nothing matches."""
    c = compile_pattern(pattern)
    names = [x for x in c.labels if x not in c.substs]
    groups = _numbered(c.regex)
    parts = [F.regexp_extract(s, c.regex, groups[re.sub(r"[^A-Za-z0-9]", "", n)]).alias(n) for n in names]
    return F.when(s.rlike(c.regex), F.struct(*parts))


def _numbered(regex: str) -> dict[str, int]:
    """Number of each named group: capturing groups are those that open with a bare parenthesis or a name."""
    out, n, i, inside = {}, 0, 0, False
    while i < len(regex):
        if regex[i] == "\\":
            i += 2
            continue
        if regex[i] == "[" and not inside:
            inside = True
        elif regex[i] == "]" and inside:
            inside = False
        elif regex[i] == "(" and not inside:
            m = re.match(r"\(\?<([A-Za-z0-9]+)>", regex[i:])
            if m or not regex.startswith("(?", i):
                n += 1
                if m:
                    out[m[1]] = n
        i += 1
    return out


def get_frames(s: Column, pattern) -> Column:
    """The labels of every match, as an array of structs."""
    c = compile_pattern(pattern)
    every = F.regexp_extract_all(s, F.lit(f"({c.regex})"), F.lit(1))
    return F.transform(every, lambda m: get_frame(m, pattern))


def text_slice(s: Column, pattern, keep: str = "drop") -> Column:
    """Pieces between matches; keep says what becomes of these: drop, prefix (with the piece after), suffix (with the one before),
    sep (as pieces of their own)."""
    r = regex_of(pattern)
    cuts = {"drop": r, "prefix": f"(?={r})", "suffix": f"(?<={r})", "sep": f"(?={r})|(?<={r})"}
    return F.filter(F.split(s, cuts[keep]), lambda x: x != "")


def filter_rows(rows: DataFrame, column: str, pattern) -> DataFrame:
    """The rows whose text has a match."""
    return rows.where(contains(F.col(column), pattern))
