"""In-text citations: patterns, keys, guards and context, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from naskah.constants import AUTHOR_BLACKLIST
from naskah.functions import text as T

# The shape of authors, years and page suffixes.
NAME = r"\p{Lu}[\p{L}'\-]+"
NAME_PART = rf"{NAME}(?:\s+-\s+{NAME})?"
AUTHOR = rf"{NAME_PART}(?:\s+{NAME_PART})*"
YEAR = r"\d{4}[a-z]?"
ET_AL = r"(?:\s+(?:et\s+al\.?|dkk\.?))"
AND = rf"(?:\s*,\s*{AUTHOR})*(?:\s*,?\s*(?:&|and|dan)\s*{AUTHOR})?"
PAGE = r"(?:,\s*(?:p\.|pp\.|hlm\.|hal\.)\s*[\d\-–]+)?"
LEAD = r"(?:(?:dalam|dikutip\s+dari|dalam\s+penelitian|lihat|see|in)\s+)?"
ONE = rf"{LEAD}{AUTHOR}{ET_AL}?{AND}(?:,\s*{YEAR}){PAGE}"
PAREN = rf"\(\s*({ONE}(?:(?:\s*;\s*){ONE})*)\s*\)"
PART = rf"{LEAD}({AUTHOR}{ET_AL}?{AND}),\s*({YEAR})"
OPENING = (
    r"(?:(?:[Mm]enurut|[Bb]erdasarkan|[Ss]ebagaimana|[Aa]ccording\s+to|[Pp]enelitian|[Ss]tudi"
    r"|[Kk]ajian|[Rr]iset)\s+)?"
)
NARRATIVE = rf"{OPENING}({AUTHOR}{ET_AL}?{AND})\s+\(({YEAR}{PAGE})\)"
# Everything a narrative citation can hold before its year: the run that ends there, and the year.
# A run is entered at its first character only, so a page is passed once.
_RUN = rf"\p{{L}}'\-,&{T._SPACES}"
NARRATIVE_RUN = rf"(?<![{_RUN}])(?:[{_RUN}]|(?<=al|dkk)\.)++\({YEAR}{T.js(PAGE)}\)"
CONNECTOR = r"[,&]|\bet\s+al\.?\b|\bdkk\.?\b|\band\b|\bdan\b"

CONTEXT_CHARS = 150


def split_multi(inner: Column) -> Column:
    """The (author, year) parts of a parenthetical list; other parts are dropped."""
    pattern = T.js(PART)
    parts = F.transform(
        F.split(inner, T.js(r"\s*;\s*")),
        lambda p: F.struct(
            F.regexp_extract(p, pattern, 1).alias("author"),
            F.regexp_extract(p, pattern, 2).alias("year"),
        ),
    )
    return F.filter(parts, lambda p: p["author"] != "")


def citation_key(author: Column, year: Column) -> Column:
    """``Author, Year`` with one spelling of "et al.", "&" and blanks."""
    name = F.regexp_replace(author, T.js(r"\s+(?:et\s+al\.?|dkk\.?)", True), " et al.")
    name = F.regexp_replace(name, T.js(r"\s*(?:&|and|dan)\s*"), " & ")
    return F.concat_ws(", ", T.squeeze(name), T.strip(F.regexp_replace(year, T.js(r"[,\s].*"), "")))


def is_blacklisted(author: Column) -> Column:
    return F.regexp_extract(author, rf"\A{T.WS}*({T.NOT_WS}*)", 1).isin(AUTHOR_BLACKLIST)


def is_title_fragment(author: Column) -> Column:
    """More than four words and nothing that joins authors."""
    many = author.rlike(rf"(?:{T.NOT_WS}++{T.WS}++){{4}}{T.NOT_WS}")
    return many & ~author.rlike(T.js(CONNECTOR, True))


def keep_citation(author: Column) -> Column:
    return ~is_blacklisted(author) & ~is_title_fragment(author)


def context(text: Column, start: Column, end: Column) -> Column:
    """Up to 150 characters on both sides, shrunk to the sentence around the span."""
    lo = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    hi = F.least(end + CONTEXT_CHARS, F.length(text))
    before = T.slice_text(text, lo, start + 2)
    after = T.slice_text(text, end, hi + 1)
    # last ". " before the span, first ". " after it
    back = F.instr(F.reverse(before), " .")
    cut_lo = F.length(before) - back - 1
    new_lo = F.when((lo > 0) & (back > 0) & (cut_lo > 0), lo + cut_lo + 2).otherwise(lo)
    ahead = F.instr(after, ". ")
    new_hi = F.when(ahead > 0, end + ahead).otherwise(hi)
    return T.strip(T.slice_text(text, new_lo, new_hi))


def narrative_spans(text: Column) -> Column:
    """Matches of ``NARRATIVE`` as ``array<struct<start,end,text>>``.

    A match lies in one run of ``NARRATIVE_RUN`` and ends with it, so the costly pattern reads the runs only.
    """
    pattern = T.js(NARRATIVE)
    tails = F.transform(
        T.spans(text, NARRATIVE_RUN),
        lambda s: F.struct(s["end"].alias("end"), F.regexp_extract(s["text"], pattern, 0).alias("text")),
    )
    return F.transform(
        F.filter(tails, lambda t: t["text"] != ""),
        lambda t: F.struct((t["end"] - F.length(t["text"])).alias("start"), t["end"].alias("end"), t["text"].alias("text")),
    )


def page_citations(text: Column, kind: str | None = None) -> Column:
    """Citations of one page, of one kind or both: ``array<struct<key,author,year,start,end,context,raw,kind>>``.

    Repeats of one key inside one parenthesis are kept once.
    """

    def out(span: Column, author: Column, year: Column, kind: str) -> Column:
        return F.struct(
            citation_key(author, year).alias("citation_key"),
            author.alias("author"),
            year.alias("year"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["text"].alias("raw_match"),
            F.lit(kind).alias("kind"),
        )

    def first_by_key(parts: Column) -> Column:
        return T.let(
            parts,
            lambda a: F.filter(
                a,
                lambda x, i: ~F.exists(
                    F.slice(a, F.lit(1), i), lambda y: y["citation_key"] == x["citation_key"]
                ),
            ),
        )

    paren = T.js(PAREN)
    in_parens = F.flatten(
        F.transform(
            T.spans(text, paren),
            lambda s: first_by_key(
                F.transform(
                    F.filter(
                        split_multi(F.regexp_extract(s["text"], paren, 1)),
                        lambda p: keep_citation(p["author"]),
                    ),
                    lambda p: out(s, p["author"], p["year"], "parenthetical"),
                )
            ),
        )
    )
    narrative = T.js(NARRATIVE)
    in_prose = F.filter(
        F.transform(
            narrative_spans(text),
            lambda s: out(
                s,
                F.regexp_extract(s["text"], narrative, 1),
                F.regexp_replace(F.regexp_extract(s["text"], narrative, 2), T.js(r"[,\s].*"), ""),
                "narrative",
            ),
        ),
        lambda c: ~F.contains(c["author"], F.lit("\n")) & keep_citation(c["author"]),
    )
    return {"parenthetical": in_parens, "narrative": in_prose}.get(kind, F.concat(in_parens, in_prose))
