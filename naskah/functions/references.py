"""Bibliography text: section clean-up, entry splitting and entry fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from naskah.constants import BIBLIOGRAPHY_HEADINGS
from naskah.functions import text as T

HEADING = "|".join(f"(?:{h})" for h in BIBLIOGRAPHY_HEADINGS)
_MARK = "\u0001"

# Shapes of names, author lists and years that open an entry.
_PIECE = "[A-ZÀ-Ý][A-Za-zÀ-ÿ']+"
_TOKEN = rf"{_PIECE}(?:\s*[-–]\s*{_PIECE})*"
_NAME = rf"{_TOKEN}(?:\s+{_TOKEN}){{0,3}}"
_INITIALS = r"[A-Z]\.(?:[\s\-]?[A-Z]\.?){0,4}(?:\s+[A-Z][A-Za-zÀ-ÿ']+){0,2}"
_AUTHOR = rf"{_NAME}(?:,\s*{_INITIALS})?"
_SEP = r"(?:\s*,\s*(?:&|and|dan|…)?\s*|\s+(?:&|and|dan)\s+|\s*…\s*,?\s*)"
_AUTHORS = rf"{_AUTHOR}(?:{_SEP}{_AUTHOR})*(?:\s+et\s+al\.?)?"
ANCHOR = rf"{_AUTHORS}\s*(?:\(\d{{4}}[a-z]?\)|,\s*\d{{4}}[a-z]?\.)"
MID_LIST = (
    r"(?:^|[^A-Za-z])[A-Z]\.\s*(?:,\s*(?:&|and|dan|…)?\s*|\s+(?:&|and|dan|…)\s+|\s*,?\s*…\s*,?\s*)$"
)
_WORD = "[A-Z][a-zA-Zà-öø-ÿÀ-ÖØ-Ý'-]+"
ENTRY_LINE = rf"^{_WORD}[,.]?\s+.*\b(19|20)\d{{2}}\b"
_NAME_ID = rf"{_WORD}(?:[.,]\s*(?:[A-Z]\.?\s*)*)?"
SPLIT_NAMES_YEAR = (
    rf"(?:^|\n{{2,}})(?={_NAME_ID}(?:\s+(?:dan|and|&)\s+{_NAME_ID})?\s*[.,]?\s*(?:\(?\d{{4}}\)?))"
)
SPLIT_INITIAL = rf"(?:^|\n{{2,}})(?={_WORD},\s*[A-Z]\.)"
ENTRY_NUMBER = r"\n?\[\d+\]\s*"
YEAR_ANY = r"\b(19|20)\d{2}\b"
DOI = r"\b(?:doi:\s*|https?:\/\/doi\.org\/)(10\.\d{4,9}\/[^\s,)]+[^\s,).:])"
URL = r"https?:\/\/[^\s,)>\]]+"
_LINK_START = r"^(?:https?://|(?:doi:?)?10\.\d)"


def strip_page_number(text: Column) -> Column:
    return F.regexp_replace(text, T.js(r"^\s*\d{1,4}\s+"), "")


def leader(text: Column) -> Column:
    """The start of a page that may hold a running header."""
    return F.left(strip_page_number(text), F.lit(400))


def common_length(a: Column, b: Column) -> Column:
    """Length of the common start of two texts, any digit equal to any digit."""
    same = F.zip_with(
        F.split(F.regexp_replace(a, "[0-9]", "0"), ""),
        F.split(F.regexp_replace(b, "[0-9]", "0"), ""),
        lambda x, y: x.eqNullSafe(y),
    )
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.length(a)).cast("int")


def header_words(prefix: Column) -> Column:
    """Words of a running header that identify it; empty when it is too short."""
    kept = F.when(
        F.length(prefix) >= 20,
        T.strip(F.regexp_replace(prefix, T.js(r"\s+\d+\s*$"), "")),
    ).otherwise("")
    return F.filter(
        F.split(kept, T.WS + "+"), lambda w: (F.length(w) > 2) & ~w.rlike(r"^[0-9]+\z")
    )


def strip_header(text: Column, words: Column) -> Column:
    """Drop everything up to the header words found in order, and the number after them."""
    quoted = F.transform(
        words, lambda w: F.regexp_replace(w, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    )
    pattern = F.concat(F.lit("(?s)^.*?"), F.array_join(quoted, ".*?"), F.lit(f"[0-9{T._SPACES}]*"))
    return F.when(F.size(words) >= 4, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


def after_heading(text: Column) -> Column:
    """Text after the last bibliography heading."""
    return T.let(
        F.split(text, T.js(HEADING, True), -1), lambda p: T.strip(F.element_at(p, -1))
    )


def _last_token(line: Column) -> Column:
    return F.regexp_extract(line, T.NOT_WS + r"*\z", 0)


def join_url_lines(text: Column) -> Column:
    """Put lines that continue a link or DOI back onto it."""
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("open"), F.lit(True).alias("first"))

    def step(acc: Column, line: Column) -> Column:
        trimmed = T.strip(line)
        joins = acc["open"] & trimmed.rlike(r"^[a-zA-Z0-9._/?=&#%-]+\.?\z")
        return F.struct(
            F.concat(
                acc["out"],
                F.when(joins, trimmed).when(acc["first"], line).otherwise(F.concat(F.lit("\n"), line)),
            ).alias("out"),
            (joins | _last_token(line).rlike(_LINK_START)).alias("open"),
            F.lit(False).alias("first"),
        )

    return F.aggregate(F.split(text, "\n", -1), state, step)["out"]


def _long(parts: Column, least: int) -> Column:
    return F.filter(F.transform(parts, lambda p: T.strip(p)), lambda p: F.length(p) > least)


def split_by_anchors(text: Column) -> Column:
    """Entries that each start with an author list and a year."""

    def starts(found: Column) -> Column:
        return F.transform(
            F.filter(
                found,
                lambda s: ~T.slice_text(text, s["start"] - 30, s["start"]).rlike(T.js(MID_LIST)),
            ),
            lambda s: s["start"],
        )

    def slices(pos: Column) -> Column:
        return F.when(
            F.size(pos) >= 2,
            _long(
                F.transform(
                    pos,
                    lambda p, i: T.slice_text(
                        text, p, F.coalesce(F.get(pos, i + 1), F.length(text))
                    ),
                ),
                20,
            ),
        ).otherwise(F.array().cast("array<string>"))

    return T.let(starts(T.spans(text, T.js(ANCHOR))), slices)


def split_by_lines(text: Column) -> Column:
    """Entries that start on a line with a name and a year, or after a blank line."""
    state = F.struct(
        F.lit("").alias("out"), F.lit(False).alias("link"), F.lit(False).alias("busy")
    )

    def step(acc: Column, line: Column) -> Column:
        fresh = ~acc["busy"] | line.rlike(T.js(ENTRY_LINE))
        glued = ~fresh & acc["link"] & line.rlike("^[a-zA-Z0-9._/?=&#%-]")
        sep = F.when(fresh, _MARK).when(glued, "").otherwise(" ")
        one_token = ~line.rlike(T.WS)
        more = F.struct(
            F.concat(acc["out"], sep, line).alias("out"),
            ((glued & one_token) | _last_token(line).rlike(_LINK_START)).alias("link"),
            F.lit(True).alias("busy"),
        )
        blank = F.struct(
            acc["out"].alias("out"), F.lit(False).alias("link"), F.lit(False).alias("busy")
        )
        return F.when(line == "", blank).otherwise(more)

    lines = F.transform(F.split(text, "\n", -1), lambda l: T.strip(l))
    out = F.aggregate(lines, state, step)["out"]
    return F.filter(
        _long(F.split(out, _MARK), 20), lambda e: e.rlike(T.js(YEAR_ANY))
    )


def split_entries(section: Column) -> Column:
    """Entries of a section: the first way of splitting that gives two or more."""

    def cascade(text: Column) -> Column:
        ways = [
            _long(F.split(text, T.js(ENTRY_NUMBER), -1), 10),
            split_by_anchors(text),
            split_by_lines(text),
            _long(F.split(text, T.js(r"\n\s*\n"), -1), 20),
            _long(F.split(text, T.js(SPLIT_NAMES_YEAR), -1), 20),
            _long(F.split(text, T.js(SPLIT_INITIAL), -1), 20),
        ]
        tried = [T.let(w, lambda e: F.when(F.size(e) >= 2, e)) for w in ways]
        return F.coalesce(*tried, _long(F.array(text), 20))

    return T.let(join_url_lines(after_heading(section)), cascade)


def _found(text: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
    return F.nullif(F.regexp_extract(text, T.js(pattern, ignore_case), group), F.lit(""))


def ref_year(raw: Column) -> Column:
    return F.coalesce(
        _found(raw, r"\((\d{4})[a-z]?[,)]", 1),
        _found(raw, r"^[A-Z][a-zA-Zà-öø-ÿÀ-ÖØ-Ý',\-\s]+?[.,]\s*((?:19|20)\d{2})[a-z]?\s*[.,]", 1),
        _found(raw, r"\b(19\d{2}|20[0-2]\d)\b", 1),
        F.lit("n.d."),
    )


def ref_doi(raw: Column) -> Column:
    return _found(raw, DOI, 1, True)


def ref_url(raw: Column) -> Column:
    def choose(urls: Column) -> Column:
        other = F.filter(urls, lambda u: ~F.contains(u, F.lit("doi.org")))
        return F.coalesce(F.get(other, F.lit(0)), F.get(urls, F.lit(0)))

    return T.let(F.regexp_extract_all(raw, F.lit(T.js(URL)), F.lit(0)), choose)


# Entry shapes, tried in this order; author is group 1, the rest the last group.
_SHAPES = [
    (r"(?s)^(.+?)\s*\((\d{4})[a-z]?(?:,\s*\w+)?\)\.\s*(.*)$", "plain"),
    (r"(?s)^(.+?)\s*\((\d{4})[a-z]?\)\s*['\"]?\s*(.*)$", "plain"),
    (r"(?s)^(.+?),\s*((?:19|20)\d{2})[a-z]?\.\s+(.*)$", "names"),
    (r"(?s)^(.+?)[.,]\s*((?:19|20)\d{2})[a-z]?\s*[.,]\s*(.*)$", "plain"),
]


def author_and_rest(raw: Column) -> Column:
    """``struct<author,rest>``; null when no shape fits."""

    def tidy(author: Column) -> Column:
        return T.strip(F.regexp_replace(author, T.js(r"[.,\s]+$"), ""))

    def shape(pattern: str, kind: str) -> Column:
        regex = T.js(pattern)
        author = tidy(F.regexp_extract(raw, regex, 1))
        fits = raw.rlike(regex)
        if kind == "names":
            fits = fits & author.rlike("[A-Z]") & (F.length(author) < 200)
        return F.when(
            fits, F.struct(author.alias("author"), F.regexp_extract(raw, regex, 3).alias("rest"))
        )

    def by_year(parts: Column) -> Column:
        head = F.get(parts, F.lit(0))
        tail = F.substring(raw, F.length(head) + 1, 1_000_000_000)
        return F.when(
            (F.size(parts) == 2) & (F.length(head) > 3),
            F.struct(
                tidy(head).alias("author"),
                F.regexp_replace(tail, T.js(r"^\(?\d{4}\)?[.,\s]*"), "").alias("rest"),
            ),
        )

    return F.coalesce(
        *[shape(p, k) for p, k in _SHAPES], T.let(F.split(raw, r"\(?[0-9]{4}\)?", 2), by_year)
    )


def title_of(rest: Column) -> Column:
    """Quoted or period-ended title of more than five characters, else the first 200."""

    def pick(text: Column) -> Column:
        ended = _found(text, r"(?s)^(.+?)[.'\"]\s+(?=[A-Z]|$)", 1)
        period = _found(text, r"(?s)^(.+?)\.\s+(?=[A-Z])", 1)
        return F.coalesce(
            F.when(F.length(ended) > 5, T.strip(ended)),
            F.when(F.length(period) > 5, T.strip(period)),
            T.strip(F.regexp_replace(F.left(text, F.lit(200)), T.js(r"[.'\"]\s*$"), "")),
        )

    return T.let(F.regexp_replace(rest, "^['\"]+", ""), pick)


def venue_of(rest: Column, title: Column) -> Column:
    """``struct<publisher,journal>`` from the text after the title."""

    def clean(text: Column) -> Column:
        out = F.regexp_replace(T.strip(text), T.js(r"^[.,'\"]+\s*"), "")
        # only the first DOI goes
        doi = F.regexp_extract(out, T.js(DOI, True), 0)
        at = F.instr(out, doi)
        out = F.when(
            doi != "",
            F.concat(
                F.left(out, at - 1), F.substring(out, at + F.length(doi), 1_000_000_000)
            ),
        ).otherwise(out)
        out = F.regexp_replace(out, T.js(URL), "")
        for word in ("diakses", "tersedia", "retrieved", "available"):
            out = F.regexp_replace(out, T.js(rf"\b{word}\b.*$", True), "")
        out = F.regexp_replace(out, r"(?i)\[(?:daring|online|Disertasi|Skripsi|Tesis)\]", "")
        return T.strip(out)

    def kind(text: Column) -> Column:
        volume = (
            text.rlike(r"[0-9]+\([0-9]+\)")
            | text.rlike(T.js(r",\s*\d+\s*[,(]"))
            | text.rlike(T.js(r"vol\.\s*\d+", True))
        )
        plain = F.regexp_replace(text, T.js(r"\.\s*$"), "")
        none = F.lit(None).cast("string")
        usable = F.length(text) >= 3
        publisher = F.contains(text, F.lit(": ")) | ((F.length(text) > 3) & (F.length(text) < 100))
        return F.struct(
            F.when(usable & ~volume & publisher, plain).otherwise(none).alias("publisher"),
            F.when(usable & volume, plain).otherwise(none).alias("journal"),
        )

    at = F.instr(rest, title)
    after = F.when(at > 0, F.substring(rest, at + F.length(title), 1_000_000_000)).otherwise("")
    return T.let(clean(after), kind)


def parse_entry(raw: Column) -> Column:
    """All fields of one entry as a struct."""

    def with_parts(parts: Column) -> Column:
        return T.let(
            F.coalesce(title_of(parts["rest"]), F.left(raw, F.lit(200))),
            lambda title: T.let(
                venue_of(parts["rest"], title),
                lambda venue: F.struct(
                    F.coalesce(parts["author"], F.lit("Unknown")).alias("author"),
                    ref_year(raw).alias("year"),
                    title.alias("title"),
                    ref_doi(raw).alias("doi"),
                    ref_url(raw).alias("url"),
                    venue["publisher"].alias("publisher"),
                    venue["journal"].alias("journal"),
                ),
            ),
        )

    return T.let(author_and_rest(raw), with_parts)
