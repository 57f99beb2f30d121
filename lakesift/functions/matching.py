"""Matches with offsets, context windows, keyword occurrences and masks, as Column functions.

Offsets and lengths are code points.  A null text has no matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<m:string,pos:int>>"
#: What ``(?U)\\s`` matches, and the separators \\x1c to \\x1f.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def any_of(words: Iterable[str]) -> str:
    """A pattern that finds any of ``words``."""
    return "|".join(re.escape(w) for w in words)


def grouped(words: Iterable[str]) -> str:
    """``any_of`` by first characters, for Java: at each character it tries those words only that begin with it."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    heads = "".join(map(re.escape, rest))
    return f"(?=[{heads}])(?:" + "|".join(f"{re.escape(k)}(?:{any_of(v)})" for k, v in rest.items()) + ")"


def contains_any(c: Column, words: Iterable[str], cyrillic: Column | None = None) -> Column:
    """Looked for in bytes: a pattern of alternatives tries each of them at every character.

    Where ``cyrillic`` is false, words that begin with a Cyrillic letter are not looked for.
    """
    words = tuple(dict.fromkeys(words))
    least = [w for w in words if not any(v != w and v in w for v in words)]
    gated = [w for w in least if cyrillic is not None and "а" <= w[0] <= "я"]
    found = [c.contains(w) for w in least if w not in gated]
    if gated:
        found.append(cyrillic & reduce(or_, [c.contains(w) for w in gated]))
    return F.coalesce(reduce(or_, found), F.lit(False))


def count_contained(c: Column, words: Iterable[str]) -> Column:
    """How many of ``words`` occur."""
    return sum((F.coalesce(c.contains(w), F.lit(False)).cast("long") for w in words), F.lit(0).cast("long"))


def count(c: Column, rx: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(rx)), F.lit(0)).cast("long")


def extract(c: Column, rx: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(rx), F.lit(group)), F.array().cast("array<string>"))


def size(c: Column) -> Column:
    return F.size(c).cast("long")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: as the element of an array, since lambdas repeat what they are given."""
    return F.transform(F.array(value), body)[0]


def before_each(steps: Column, field: str) -> Column:
    """Of each element the sum of ``field`` over those before it, by blocks of 64: no list is copied for every element."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.shiftright(i, 6)
    values = F.transform(steps, lambda x: x[field])

    def sums(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda b: total(F.slice(v, b * 64 + 1, 64)))
        upto = lambda own: F.transform(own, lambda _, b: total(F.slice(own, F.lit(1), b)))
        each = lambda ahead: F.transform(v, lambda _, i: ahead[block(i)] + total(F.slice(v, block(i) * 64 + 1, i.bitwiseAND(F.lit(63)))))
        return once(once(blocks, upto), each)

    return once(values, sums)


def spans(c: Column, rx: str) -> Column:
    """Every match with its 0-based offset: the lengths of matches and of what is between them, summed along the row.

    Rows without a match skip the sums.
    """
    found = F.regexp_extract_all(c, F.lit(rx), F.lit(0))
    # each match with what is between it and the one before; a split would compile the pattern for every row
    upto = F.regexp_extract_all(c, F.lit(rf"(?s)\G.*?(?:{rx})"), F.lit(0))
    steps = F.zip_with(found, upto, lambda m, u: F.struct(m.alias("m"), (F.length(u) - F.length(m)).alias("gap"), F.length(u).alias("all")))
    at = lambda x, ahead: F.struct(x["m"].alias("m"), (ahead + x["gap"]).alias("pos"))
    many = lambda s: F.zip_with(s, before_each(s, "all"), at)
    some = once(steps, lambda s: F.when(F.size(s) > 1, many(s)).otherwise(F.transform(s, lambda x: at(x, F.lit(0)))))
    return F.when(F.coalesce(c.rlike(rx), F.lit(False)), some).otherwise(F.array().cast(SPAN))


def in_context(
    c: Column, low: Column, rx: str, words: Iterable[str], width: int, test: Callable[[Column], Column] | None = None, cyrillic: Column | None = None
) -> Column:
    """Spans with any of ``words`` within ``width`` characters of the match's start, in ``low``."""
    near = grouped(words)

    def keep(x: Column) -> Column:
        a = F.greatest(x["pos"] - width, F.lit(0))
        ok = F.substr(low, a + 1, x["pos"] + width - a).rlike(near)
        return ok & test(x["m"]) if test else ok

    found = F.filter(spans(c, rx), keep)
    return F.when(contains_any(low, words, cyrillic), found).otherwise(F.array().cast(SPAN))


def occurrences(c: Column, low: Column, words: Iterable[str]) -> Column:
    """Masked surroundings of each place where a word starts, overlaps included.

    Words are taken in their order and places within a word from left to right; a place counts once, for the first word.
    """
    out = F.array().cast("array<string>")
    for i, word in enumerate(words := tuple(words)):
        earlier = "".join(f"(?!{re.escape(w)})" for w in words[:i])
        # the word's first character is matched and its rest looked at: overlapping places are found
        head, rest = re.escape(word[0]), re.escape(word[1:])
        places = spans(low, f"{earlier}{head}(?={rest})")
        around = F.transform(places, _masked_around(c, len(word)))
        out = F.concat(out, F.when(F.coalesce(low.contains(word), F.lit(False)), around).otherwise(F.array().cast("array<string>")))
    return out


def _masked_around(c: Column, n: int) -> Callable[[Column], Column]:
    """Two characters on each side of the ``n`` from a place, masked."""
    return lambda x: mask(F.substr(c, F.greatest(x["pos"] - 2, F.lit(0)) + 1, F.least(x["pos"], F.lit(2)) + n + 2), 2)


def count_occurrences(low: Column, words: Iterable[str]) -> Column:
    return count(low, f"(?={any_of(words)})")


def only(seen: Column, value: Column, otherwise: Column | None = None) -> Column:
    """A number (or array) that is worked out only where ``seen``."""
    return F.when(seen, value).otherwise(F.lit(0).cast("long") if otherwise is None else otherwise)


def none() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(BLANKS))


def mask(c: Column, keep: int) -> Column:
    """Stars but for ``keep`` characters at both ends; all stars where the value is short."""

    def stars(s: Column) -> Column:
        n = F.length(s)
        long = F.concat(F.substr(s, F.lit(1), F.lit(keep)), F.repeat(F.lit("*"), n - 2 * keep), F.substr(s, n - keep + 1, F.lit(keep)))
        return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(long)

    return once(strip(c), stars)


def mask_around(c: Column, span: Column, width: int = 10) -> Column:
    """The match as stars between ``width`` raw characters on each side."""
    pos, n = span["pos"], F.length(span["m"])
    before = F.substr(c, F.greatest(pos - width, F.lit(0)) + 1, F.least(pos, F.lit(width)))
    return strip(F.concat(before, F.repeat(F.lit("*"), n), F.substr(c, pos + n + 1, F.lit(width))))


def normalize(c: Column) -> Column:
    """Form feeds and runs of blanks become one space, ends are stripped, line ends stay; null is empty."""
    return F.coalesce(strip(F.regexp_replace(c, "[ \t\f]{2,}|[\t\f]", " ")), F.lit(""))


def format_time(ts: Column) -> Column:
    """Like ``mar 5 9:57``: leading zeros of day and hour go."""
    return F.replace(F.lower(F.date_format(ts, "MMM dd HH:mm")), F.lit(" 0"), F.lit(" "))


def format_examples(values: Column, limit: int = 3) -> Column:
    """The first ``limit`` values in backticks, then ``(+N)`` for the others."""
    shown = F.transform(F.slice(values, 1, limit), lambda v: F.concat(F.lit("`"), v, F.lit("`")))
    more = F.concat(F.lit("(+"), (F.size(values) - limit).cast("string"), F.lit(")"))
    return F.array_join(F.when(F.size(values) > limit, F.concat(shown, F.array(more))).otherwise(shown), ", ")
