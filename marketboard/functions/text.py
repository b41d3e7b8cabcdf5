from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketboard.functions.numbers import int_div

# ---- fixed values: the characters that separate words (Unicode white space and the four
# ---- information separators) ----------------------------------------------------------------
WORD_BREAK = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)
# Bytes without which a text has no such character but the blank. A text with one of them may have none.
BREAK_BYTES = (
    *(bytes([b]) for b in (*range(0x09, 0x0E), *range(0x1C, 0x20))),
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80",
)


def words(text: Column) -> Column:
    """Words of a text in order, without empty ones. `text` should be a column or lambda variable, as it is read repeatedly.

    Most texts are split at blanks alone, for which Spark needs no regular expression.
    """
    data = text.cast("binary")
    breaks = reduce(lambda a, b: a | b, [F.contains(data, F.lit(b)) for b in BREAK_BYTES])
    return F.array_remove(F.when(breaks, F.split(text, WORD_BREAK)).otherwise(F.split(text, " ")), "")


def word_windows(word_list: Column, size: int, overlap: int, min_chars: int | None) -> Column:
    """Overlapping runs of `size` words, each starting `size - overlap` words after the last.

    Only runs longer than `min_chars` characters stay; None keeps every run. `word_list` should be
    a column or lambda variable, not an expression, so that the text is split only once.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    count = F.size(word_list)
    last_start = int_div(count - 1, F.lit(step)).cast("int") * F.lit(step)
    starts = F.sequence(F.lit(0), last_start, F.lit(step))
    runs = F.transform(
        starts, lambda s: F.array_join(F.slice(word_list, s + F.lit(1), F.lit(size)), " ")
    )
    if min_chars is not None:
        runs = F.filter(runs, lambda run: F.length(run) > F.lit(min_chars))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))


def placeholder(position: int) -> str:
    return f"__TERM{position}__"


def masking(text: Column, terms: Sequence[str]) -> Column:
    """Mask protected terms, in list order, and tell which ones were there.

    Gives struct(masked, found): each term replaced by its placeholder, and the (key, value) pairs of
    placeholder and term. A term counts only if it is still there once the terms before it are
    masked, so the list is folded over the text step by step.
    """
    pair = "struct<key: string, value: string>"
    steps = F.array(
        *[
            F.struct(F.lit(placeholder(i)).alias("key"), F.lit(term).alias("value"))
            for i, term in enumerate(terms)
        ]
    )
    start = F.struct(text.alias("masked"), F.array().cast(f"array<{pair}>").alias("found"))

    def step(done: Column, it: Column) -> Column:
        masked = done["masked"]
        return F.struct(
            F.replace(masked, it["value"], it["key"]).alias("masked"),
            F.when(
                F.contains(masked, it["value"]), F.array_append(done["found"], it)
            ).otherwise(done["found"]).alias("found"),
        )

    return F.aggregate(steps, start, step)


def mask_terms(text: Column, terms: Sequence[str]) -> Column:
    """Replace each protected term, in list order, by its placeholder."""
    return reduce(
        lambda masked, it: F.replace(masked, F.lit(it[1]), F.lit(placeholder(it[0]))),
        enumerate(terms),
        text,
    )


def restore_terms(text: Column, terms: Sequence[str], present: Column | None = None) -> Column:
    """Put the protected terms back, only those listed in `present` when that map is given."""
    restored = text
    for i, term in enumerate(terms):
        done = F.replace(restored, F.lit(placeholder(i)), F.lit(term))
        if present is not None:
            done = F.when(F.map_contains_key(present, placeholder(i)), done).otherwise(restored)
        restored = done
    return restored


def speech_text(text: Column, limit: int) -> Column:
    """The part of a text that a speech service takes; the limit is the service's own."""
    return F.left(text, F.lit(limit))


def filled(value: Column, default: str) -> Column:
    """Value as text with a default for NULL."""
    return F.coalesce(value.cast("string"), F.lit(default))


def template(pattern: str, fields: Mapping[str, Column]) -> Column:
    """Fill `{name}` slots of a text pattern; a NULL field makes the whole text NULL."""
    parts, rest = [], pattern
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(fields[name].cast("string"))
    return F.concat(*parts)
