"""Column building blocks for text held in one row (a page, an entry, a query).

Offsets are 0-based code points; ranges are half-open ``struct<start:int,end:int>``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_TYPE = "array<struct<start:int,end:int>>"

# JavaScript \s as an explicit class: Java's \s is ASCII only.
_SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{_SPACES}]"
NOT_WS = f"[^{_SPACES}]"
# ASCII word boundaries: Java's \b also counts accented letters as word characters.
_W = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def js(pattern: str, ignore_case: bool = False) -> str:
    r"""A pattern whose ``\b``, ``\s``, ``\S`` and ``$`` keep their JavaScript meaning in Java."""
    # Next to a plain word character one look-around says the same as a boundary.
    pattern = re.sub(
        r"\\b(?=(?:\((?:\?:)?)*(?:[A-Za-z0-9]|\\[wd]|\[A-Z\]|\[A-Z\]\[a-z))", rf"(?<!{_W})", pattern
    )
    pattern = re.sub(r"(?<=[^\\][a-z])(\)?)\\b", rf"\1(?!{_W})", pattern)
    inside = {r"\s": _SPACES}
    outside = {r"\s": WS, r"\S": NOT_WS, r"\b": _BOUNDARY}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            pair = pattern[i : i + 2]
            out.append((inside if in_class else outside).get(pair, pair))
            i += 2
            continue
        ch = pattern[i]
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(r"\z" if ch == "$" and not in_class else ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _prefix_sums(values: Column) -> Column:
    """Exclusive running sums of an int array.

    Two levels (blocks of about sqrt(n)), so a page with many matches costs
    n^1.5 steps instead of n^2. Few values are summed up directly.
    """

    def direct(arr: Column) -> Column:
        return F.transform(
            arr, lambda _, i: F.aggregate(F.slice(arr, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        )

    def blocked(arr: Column) -> Column:
        n = F.size(arr)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

        def with_blocks(blocks: Column) -> Column:
            totals = F.transform(
                blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)
            )

            def with_totals(tot: Column) -> Column:
                starts = F.transform(
                    tot,
                    lambda _, i: F.aggregate(
                        F.slice(tot, F.lit(1), i), F.lit(0), lambda a, x: a + x
                    ),
                )
                return let(
                    starts,
                    lambda st: F.flatten(
                        F.transform(
                            blocks,
                            lambda b, i: F.transform(
                                b,
                                lambda _, j: F.get(st, i)
                                + F.aggregate(
                                    F.slice(b, F.lit(1), j),
                                    F.lit(0),
                                    lambda a, x: a + x,
                                ),
                            ),
                        )
                    ),
                )

            return let(totals, with_totals)

        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width),
            lambda s: F.slice(arr, s + 1, width),
        )
        return let(blocks, with_blocks)

    return let(values, lambda arr: F.when(F.size(arr) <= 24, direct(arr)).otherwise(blocked(arr)))


def spans(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as ``array<struct<start,end,text>>``.

    The pattern must not match the empty string. One pass puts a private-use mark around each
    match, so that a split gives gaps and matches in turn; a text that holds the mark itself
    takes its matches from ``regexp_extract_all`` and the gaps from ``split``.
    """
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    apart = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda gap, match: F.array(gap, match)))
    pieces = F.when(F.contains(text, F.lit(_MARK)), F.slice(apart, 1, F.size(apart) - 1)).otherwise(marked)
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def at(piece: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(piece)).alias("end"), piece.alias("text"))

    def place(p: Column) -> Column:
        return let(
            _prefix_sums(F.transform(p, lambda x: F.length(x))),
            lambda before: F.transform(
                F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: at(F.get(p, i), F.get(before, i))
            ),
        )

    return let(pieces, lambda p: F.when(F.size(p) > 1, place(p)).otherwise(empty))


_MARK = "\ue000"


def span_ranges(text: Column, pattern: str) -> Column:
    """``spans`` without the text."""
    return F.transform(
        spans(text, pattern),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )


def no_ranges() -> Column:
    return F.array().cast(RANGE_TYPE)


def overlaps(start: Column, end: Column, ranges: Column) -> Column:
    """True when [start, end) meets any range; zero-length spans count inside one."""
    return F.exists(ranges, lambda r: (start < r["end"]) & (end > r["start"]))


def in_ranges(offset: Column, ranges: Column) -> Column:
    """True when a point lies in any half-open range."""
    return F.exists(ranges, lambda r: (offset >= r["start"]) & (offset < r["end"]))


def parse_ranges(raw: Column) -> Column:
    """JSON ``[[s,e],…]`` text to ranges; anything malformed gives no ranges."""
    parsed = F.from_json(raw, "array<array<int>>")
    return F.coalesce(
        F.transform(
            F.filter(parsed, lambda p: F.size(p) == 2),
            lambda p: F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end")),
        ),
        no_ranges(),
    )


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with 0-based code points, clamped at 0."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(text, lo + 1, F.greatest(end - lo, F.lit(0)))


def squeeze(text: Column) -> Column:
    """Whitespace runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def excerpt(text: Column, start: Column, end: Column, margin: int = 30) -> Column:
    """The span with ``margin`` characters on both sides, squeezed."""
    return squeeze(slice_text(text, start - margin, end + margin))


def icontains(text: Column, needle: str) -> Column:
    """Case-insensitive literal substring test; no wildcard has a meaning."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def _letter_table(ranges: list[tuple[int, int]], form: str) -> tuple[str, str]:
    """Characters whose decomposition, without marks, is one ASCII letter or digit."""
    src, dst = [], []
    for lo, hi in ranges:
        for cp in range(lo, hi + 1):
            base = "".join(
                c for c in unicodedata.normalize(form, chr(cp)) if not unicodedata.combining(c)
            ).lower()
            if len(base) == 1 and base.isascii() and base.isalnum() and base != chr(cp):
                src.append(chr(cp))
                dst.append(base)
    return "".join(src), "".join(dst)


_LATIN = _letter_table([(0xC0, 0x24F), (0x1E00, 0x1EFF)], "NFD")
_COMPAT = _letter_table(
    [(0xAA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2070, 0x209C), (0xFF10, 0xFF5A)], "NFKD"
)
_COMBINING = r"[\u0300-\u036f]"


def fold_accents(text: Column, table: tuple[str, str] = _LATIN) -> Column:
    """Lower-case and drop accents of Latin letters (and combining marks)."""
    return F.regexp_replace(F.translate(F.lower(text), *table), _COMBINING, "")


def fold_name(text: Column) -> Column:
    """Name form: folded, straight quotes, plain dashes without blanks around."""
    folded = F.regexp_replace(fold_accents(text), r"`", "'")
    return strip(F.regexp_replace(folded, rf"{WS}*[-–—]{WS}*", "-"))


def fold_title(text: Column) -> Column:
    """Title form: folded, only a-z 0-9 and single blanks."""
    return squeeze(F.regexp_replace(fold_accents(text, _COMPAT), r"[^a-z0-9\s]", " "))


def round_half_up(value: Column) -> Column:
    """Rounds .5 towards +infinity."""
    return F.floor(value + 0.5)


def round2(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def mean2(value: Column) -> Column:
    """Mean of 2-place values, 2 places. Sums whole hundredths, so row order cannot matter."""
    return F.floor(F.avg(F.round(value * 100).cast("bigint")) + 0.5) / 100
