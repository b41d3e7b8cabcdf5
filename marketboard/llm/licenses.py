"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags in one pass over each text, and a
shunting-yard parser evaluates the licence expressions that follow the tags.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from marketboard.llm.common import per_text

# ---- fixed values: the plain phrases and their labels ------------------------------------------
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# ---- fixed values: further notice phrases, as words --------------------------------------------
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "apache software license": "apache",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"

# ---- fixed values: how freely works under a licence may be used, from 0 to 1 ---------------------
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0,
    "cc-by": 0.9, "lgpl": 0.6, "mpl": 0.6, "epl": 0.6, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1,
}
UNKNOWN_FREEDOM = 0.1
#: An exception to a strict licence allows linking.
EXCEPTION_FREEDOM = 0.5
# ---- fixed values: identifiers that say that no licence is told; restrictions of one family, in order ----
NO_LICENCE = {"none", "noassertion"}
RESTRICTIONS = {
    "noncommercial": "nc", "non commercial": "nc", "noderivatives": "nd", "noderivs": "nd", "no derivatives": "nd",
    "no derivs": "nd", "sharealike": "sa", "share alike": "sa",
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TAG = re.compile(rb"spdx-license-identifier[\x20\x09]*:[\x20\x09]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*|\S")
_SLASH = re.compile(r"(?<=[a-z0-9.+)])/(?=[a-z0-9(])")
#: Names with a version of their own, or without one.
_FAMILY = re.compile(r"cc-by(?:-nc)?(?:-nd|-sa)?|cc0|0bsd|[a-z]+")
_VERSION = re.compile(r"-v?\d[a-z0-9.+-]*$")
_EXCEPTION = re.compile(r"exception|-note")
_RESTRICTION = re.compile(" (" + "|".join(RESTRICTIONS) + ")(?= )")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for base, table in ((True, PHRASES), (False, NOTICES), (False, {TAG: None})):
        for phrase, label in table.items():
            found.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
    found.make_automaton()
    return found


def family(identifier: str) -> str:
    """The label of a licence identifier: a known name without version and suffixes, any other one without its version."""
    name = _FAMILY.match(identifier)
    if name and name[0] in FREEDOM:
        return name[0]
    return _VERSION.sub("", identifier)


def restricted(line: str, at: int) -> str:
    """The label of an attribution notice that ends before place `at` of a line of words, by the words that follow it."""
    found = set()
    while match := _RESTRICTION.match(line, at):
        found.add(RESTRICTIONS[match[1]])
        at = match.end()
    return "-".join(["cc-by", *(r for r in ("nc", "nd", "sa") if r in found)])


def postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order by the shunting-yard algorithm; null if it is none.

    with binds more tightly than and, and than or; a slash between two names is an or. What follows a complete expression, such as the end of a comment, is
    left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True
    depth = 0
    for token in _TOKEN.findall(_SLASH.sub(" or ", expression)):
        if operand:
            if token == "(":
                stack.append(token)
                depth += 1
            elif token[0].isalnum() and token not in PRECEDENCE:
                out.append(token)
                operand = False
            else:
                return None
        elif token in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            break
    if operand or depth:
        return None
    return out + stack[::-1]


def evaluate(order: list[str]) -> tuple[set[str], float]:
    """Labels of an expression and its freedom: a choice is as free as its freest part, a sum as its strictest.

    An exception frees a known licence only. Names that say that there is no licence have no label.
    """
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in PRECEDENCE:
            label = family(token)
            stack.append((set() if token in NO_LICENCE else {label}, FREEDOM.get(label, UNKNOWN_FREEDOM)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            frees = left[0] & FREEDOM.keys() and any(_EXCEPTION.search(name) for name in right[0])
            stack.append((left[0], max(left[1], EXCEPTION_FREEDOM) if frees else left[1]))
        else:
            stack.append((left[0] | right[0], max(left[1], right[1]) if token == "or" else min(left[1], right[1])))
    return stack[0]


def scan(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    lower = raw.lower()
    words = _WORD.findall(lower)
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tagged = False
    for end, (size, label, plain) in automaton().iter(line):
        if plain:
            places.append(end + 1 - size)
            base.add(label)
        if label == "cc-by":
            # the match ends with the space behind it
            label = restricted(line, end)
        if label:
            labels.add(label)
        else:
            tagged = True
    freedoms = [FREEDOM[label] for label in labels]
    if tagged:
        for match in _TAG.finditer(lower):
            order = postfix(match[1].decode("utf-8", "replace"))
            if order and not NO_LICENCE.issuperset(order):
                more, freedom = evaluate(order)
                labels |= more
                freedoms.append(freedom)
    first = line.count(" ", 0, min(places)) if places else None
    last = line.count(" ", 0, max(places)) if places else None
    score = min(freedoms, default=0.0)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scanned(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, plain phrases, labels and score of every document, one row for each row.

    score: how freely the text may be used as far as its notices tell, the strictest of them; 0 if there is none. Null and
    empty texts have no words and no labels (empty strings). Repeated rows and repeated or null keys keep a row each; no
    documents, no rows. Other columns are not read.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = ["long", "long", "long", "long", "string", "string", "double"]

    def run(texts: list[bytes]) -> dict:
        import pyarrow as pa

        columns = zip(*map(scan, texts), strict=True)
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return {n: pa.array(c, types[k]) for n, k, c in zip(names, kinds, columns, strict=True)}

    return per_text(documents, key, text, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), run)
