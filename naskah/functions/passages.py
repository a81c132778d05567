"""Sentences, windows, tokens, keywords and anchors of passages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from naskah.constants import (
    ABBREVIATIONS, BODY_OPENERS, FRONT_MATTER_SIGNALS, STOPWORDS,
    WINDOW_SENTENCES, WINDOW_STRIDE,
)
from naskah.functions import text as T

_SPLIT = "\u0001"
_ENDS_ABBREVIATION = (
    r"(?i)(?:^| )(?:[a-z]|" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\. *\z"
)
_MIN_BODY = 80


def sentences(text: Column) -> Column:
    """Sentences of a text; a break after an abbreviation is no break."""
    flat = F.regexp_replace(text, T.WS + "+", " ")
    parts = F.split(flat, r"(?<=[.!?]) (?=[A-Z0-9])")
    # The separator after each part says whether a sentence ends there.
    marked = F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(
                p, F.when(p.rlike(_ENDS_ABBREVIATION), " ").otherwise(_SPLIT)
            ),
        ),
        "",
    )
    return F.filter(
        F.transform(F.split(marked, _SPLIT), lambda s: F.trim(s)), lambda s: s != ""
    )


def looks_like_front_matter(text: Column) -> Column:
    """At least two masthead signals."""
    total = F.lit(0)
    for pattern, ignore_case in FRONT_MATTER_SIGNALS:
        total = total + text.rlike(T.js(pattern, ignore_case)).cast("int")
    return total >= 2


def strip_front_matter(text: Column) -> Column:
    """The text after the body opener, when the page is front matter and enough remains."""

    def after(opener: str) -> Column:
        return T.let(
            F.split(text, T.js(opener, True), 2),
            lambda p: F.when(F.size(p) == 2, T.strip(F.get(p, F.lit(1)))),
        )

    body = F.coalesce(*[after(o) for o in BODY_OPENERS])
    return F.when(
        looks_like_front_matter(text),
        T.let(body, lambda b: F.when(F.length(b) >= _MIN_BODY, b).otherwise(text)),
    ).otherwise(text)


def windows(
    sentence_list: Column, size: int = WINDOW_SENTENCES, stride: int = WINDOW_STRIDE
) -> Column:
    """Sliding windows of sentences; a short list gives one window, an empty list none."""
    step = max(1, stride)

    def slide(s: Column) -> Column:
        last = F.greatest(F.ceil((F.size(s) - size) / step).cast("int"), F.lit(0))
        return F.when(
            F.size(s) > 0,
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.array_join(F.slice(s, i * step + 1, F.lit(size)), " "),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return T.let(sentence_list, slide)


def bm25_tokens(text: Column) -> Column:
    """Lower-case ASCII tokens of two or more characters without stopwords, repeats kept."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def ngrams(words: Column, n: int) -> Column:
    """Joined runs of ``n`` words; none when there are fewer words."""
    return T.let(
        words,
        lambda w: F.when(
            F.size(w) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - n),
                lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def shingles(words: Column, n: int = 2) -> Column:
    """Distinct runs of ``n`` words; a shorter list gives itself as one run."""
    return T.let(
        words,
        lambda w: F.when(F.size(w) >= n, F.array_distinct(ngrams(w, n)))
        .when(F.size(w) > 0, F.array(F.array_join(w, " ")))
        .otherwise(F.array().cast("array<string>")),
    )


def normalize(text: Column) -> Column:
    return T.squeeze(F.lower(text))


def text_ngrams(text: Column, n: int) -> Column:
    return ngrams(F.filter(F.split(normalize(text), " "), lambda w: w != ""), n)


def strip_markers(text: Column) -> Column:
    """Text without parenthetical and narrative citation markers."""
    out = F.regexp_replace(text, T.js(r"\([^)]*\b\d{4}[a-z]?\b[^)]*\)"), " ")
    out = F.regexp_replace(
        out,
        T.js(r"\b[A-Z][a-zA-Z]+(?:\s*(?:&|et\s+al\.?)\s*[A-Z][a-zA-Z]+)?\s*\(\d{4}[a-z]?\)"),
        " ",
    )
    return T.squeeze(out)


def keywords(text: Column) -> Column:
    """Distinct capitalised words, numbers of two or more digits and all-capital words."""
    words = F.transform(
        F.split(text, T.WS + "+"), lambda w: F.regexp_replace(w, "[.,;:!?()\"']", "")
    )

    def of(w: Column) -> Column:
        name = (w.rlike("^[A-Z][a-z]+") & (F.length(w) > 2)) | w.rlike(r"^[A-Z]{2,}\z")
        return F.array_compact(
            F.array(F.when(name, F.lower(w)), F.when(w.rlike(r"[0-9]{2,}"), w))
        )

    return F.array_distinct(F.flatten(F.transform(words, of)))


def proper_nouns(text: Column) -> Column:
    """Distinct names inside a sentence, acronyms and CamelCase words, lower-case."""
    # the capital is asked for first: the look-behind then runs at few places
    mid = F.regexp_extract_all(
        text, F.lit(T.js(r"(?=[A-Z])(?<=\S\s)([A-Z][a-zA-Z]{2,}|[A-Z]{2,})")), F.lit(1)
    )
    bare = F.transform(
        F.filter(F.split(text, T.WS + "+"), lambda w: w.rlike("[A-Z][^A-Z]*[A-Z]")),
        lambda w: F.regexp_replace(w, "[^A-Za-z]", ""),
    )
    special = F.filter(
        bare,
        lambda w: w.rlike(r"^[A-Z]{2,}\z") | (w.rlike("^[A-Z][a-z]+[A-Z]") & (F.length(w) >= 4)),
    )
    none = F.array().cast("array<string>")
    special = F.when(text.rlike(r"[A-Z]\S*[A-Z]"), special).otherwise(none)
    return F.array_distinct(F.transform(F.concat(mid, special), F.lower))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(T.js(r"\b\d{2,}\b")), F.lit(0)))


def overlap_rate(left: Column, right: Column) -> Column:
    """Share of the distinct ``left`` items found in ``right``; 0 when left is empty."""
    return F.when(F.size(left) == 0, 0.0).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(left)
    )


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap of two arrays without repeats; 0 when one is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(
        both / (F.size(left) + F.size(right) - both)
    )


def edit_ratio(left: Column, right: Column, limit: int = 400) -> Column:
    """1 - edit distance / longer length over the first ``limit`` normalised characters."""
    a, b = F.left(left, F.lit(limit)), F.left(right, F.lit(limit))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(
        1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    )
