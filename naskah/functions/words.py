"""Word-level predicates and ranges of the dictionary check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from naskah.functions import text as T
from naskah.operators.rules import URL_WIDE, link_ranges

TOKEN = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'-]*"

# Citations inside running text.
ET_AL = r"\bet\s+al\.?"
PAREN_CITATION = r"\([A-Z][A-Za-z'.\- ]+,\s*\d{4}[a-z]?\)"
AUTHOR_YEAR = (
    r"\b[A-Z][a-zà-ÿ'-]+\s+(?:&|dan|and|et\s+al\.?)\s+[A-Z][a-zà-ÿ'-]+(?:\s*\(?\s*\d{4}\s*\)?)?"
)
# No letter can follow the first half, so it gives none back.
SPACED_REDUP = r"\b([A-Za-zÀ-ÿ]{2,}+)\s*-\s*\1\b"
SPLIT_REDUP = r"\b([A-Za-zÀ-ÿ]{2,}+)-\s+\1\b"
REDUP = r"^([a-zà-ÿ]+)-\1$"
REDUP_AFFIXED = r"^(ber|me|di|ter|pe|pem|pen|peng)?([a-zà-ÿ]+)-\2(an|kan|nya)?$"


_STRUCTURAL = (
    r"^[A-Z]{2,}\z|^[0-9]+\z|[a-z][A-Z]|-\z|^-|^[a-z]-[A-Z]|-[0-9]|[0-9]-|^(?=.)(?i:x{0,3}(?:ix|iv|v?i{0,3}))\z"
)


def is_structural(token: Column, at_start: Column) -> Column:
    """Tokens that are no words to look up: names, codes, fragments, Roman page numbers."""
    return token.rlike(_STRUCTURAL) | (~at_start & token.rlike("^[A-Z]"))


def skip_ranges(content: Column) -> Column:
    """Links, "et al.", (Author, Year) and Author & Author (Year)."""
    # A link holds one of these; looking for its start costs far more than for them.
    links = F.when(
        content.rlike(r"(?i)https?:|www\.|\.[a-z]"), link_ranges(content, URL_WIDE)
    ).otherwise(T.no_ranges())
    return F.concat(
        links,
        T.span_ranges(content, T.js(ET_AL, True)),
        T.span_ranges(content, T.js(PAREN_CITATION)),
        T.span_ranges(content, T.js(AUTHOR_YEAR)),
    )


def redup_offsets(content: Column) -> Column:
    """Offsets of both halves of reduplications written with blanks around the hyphen."""

    def halves(pattern: str) -> Column:
        regex = T.js(pattern, True)
        return F.flatten(
            F.transform(
                T.spans(content, regex),
                lambda s: F.array(
                    s["start"], s["end"] - F.length(F.regexp_extract(s["text"], regex, 1))
                ),
            )
        )

    return F.array_distinct(F.concat(halves(SPACED_REDUP), halves(SPLIT_REDUP)))


def redup_base(word: Column) -> Column:
    """Base of ``x-x``; null for other words."""
    return F.nullif(F.regexp_extract(word, T.js(REDUP, True), 1), F.lit(""))


def redup_affixed_base(word: Column) -> Column:
    """Base of ``x-x`` with an optional prefix and suffix around it."""
    return F.nullif(F.regexp_extract(word, T.js(REDUP_AFFIXED, True), 2), F.lit(""))


def token_spans(content: Column) -> Column:
    """Tokens of a page with offsets and the character after each.

    Lines are placed first and tokens inside their line, so no step walks a whole page.
    """
    return F.flatten(
        F.transform(
            T.spans(content, "[^\n]+"),
            lambda line: F.transform(
                T.spans(line["text"], TOKEN),
                lambda t: F.struct(
                    (line["start"] + t["start"]).alias("offset"),
                    (line["start"] + t["end"]).alias("end"),
                    t["text"].alias("token"),
                    F.substring(line["text"], t["end"] + 1, F.lit(1)).alias("gap"),
                ),
            ),
        )
    )


def sentence_starts(content: Column) -> Column:
    """Offsets at which sentences start."""
    return F.concat(
        F.array(F.lit(0)),
        F.transform(T.spans(content, T.js(r"[.!?]\s+")), lambda s: s["end"]),
    )


def italic_words(content: Column, italic: Column) -> Column:
    """Lower-case words of two or more letters inside italic ranges."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                italic,
                lambda r: F.transform(
                    F.filter(
                        F.regexp_extract_all(
                            T.slice_text(content, r["start"], r["end"]), F.lit(TOKEN), F.lit(0)
                        ),
                        lambda w: F.length(w) >= 2,
                    ),
                    lambda w: F.lower(w),
                ),
            )
        )
    )
