"""Orthography rules as data: a pattern, and column builders for what to report.

All rules of a scan run over a block of pages in one pass (``rule_scan``); a page is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from naskah.constants import LOCATIVES, PASSIVE_VERBS, PUN_FIXED
from naskah.functions import text as T
from naskah.operators import rule_scan as RS

# Links and host names.
URL = (
    r"\bhttps?:\/\/\S+|\bwww\.\S+"
    r"|\b\S+\.(?:com|org|net|ac\.id|co\.id|io|ly|gov)(?:\/\S*)?"
)
URL_WIDE = (
    r"\bhttps?:\/\/\S+|\bwww\.\S+"
    r"|\b\S+\.(?:com|org|net|ac\.id|co\.id|go\.id|sch\.id|mil\.id|or\.id|web\.id|io|ly|gov|edu|info"
    r"|dev|app|site|xyz)(?:\/\S*)?"
)

TextFn = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """``message`` and ``suggestion`` see the matched text; ``skip`` sees span and page text."""

    id: str
    severity: str
    pattern: str
    message: TextFn
    suggestion: TextFn
    ignore_case: bool = False
    skip: Callable[[Column, Column], Column] | None = None
    #: Cheap test of a page text; every text with a match passes it.
    gate: TextFn | None = None

    @property
    def regex(self) -> str:
        return T.js(self.pattern, self.ignore_case)

    def group(self, matched: Column, n: int) -> Column:
        return F.regexp_extract(matched, self.regex, n)


def _link_run(hosts: str) -> str:
    """A run without blanks that may hold a link; no link goes beyond such a run."""
    return T.js(rf"(?<!\S)\S*?(?:https?:\/\/|www\.|\.{hosts})\S*", True)


_LINK_RUNS = {URL: _link_run(r"(?:com|org|net|ac\.id|co\.id|io|ly|gov)"), URL_WIDE: _link_run("[a-z]")}


def link_ranges(content: Column, pattern: str = URL) -> Column:
    """Ranges of ``URL`` or ``URL_WIDE``, looked for in runs without blanks that may hold one."""
    return F.flatten(
        F.transform(
            T.spans(content, _LINK_RUNS[pattern]),
            lambda run: F.transform(
                T.spans(run["text"], T.js(pattern, True)),
                lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end")),
            ),
        )
    )


def _holds(*pieces: str) -> TextFn:
    return lambda t: reduce(or_, (F.contains(t, F.lit(p)) for p in pieces))


def _matches(pattern: str) -> TextFn:
    return lambda t: t.rlike(T.js(pattern))


def _const(value: str) -> TextFn:
    return lambda m: F.lit(value)


def _leader_dot(span: Column, text: Column) -> Column:
    """The period belongs to a dot leader: another period follows, or stands before the blanks."""
    after = T.slice_text(text, span["end"], span["end"] + 2)
    before = F.rtrim(T.slice_text(text, F.lit(0), span["end"] - 1))
    return F.endswith(span["text"], F.lit(".")) & (
        F.startswith(after, F.lit("."))
        | (after == " .")
        | F.endswith(before, F.lit("."))
    )


_L = "[A-Za-zÀ-ÿ]"
_DI = rf"\bdi({'|'.join(LOCATIVES)})\b"
_LAH = r"\b(\w+)\s+(lah|kah|tah)\b"
_PUN = r"\b([A-Za-zÀ-ÿ]+)pun\b"
_SPLIT_DI = r"\b(di|Di)\s+([a-zà-ÿ]{3,})\b"
_NUMBER = r"\b(\d{1,3}(?:,\d{3})+)(\.\d+)?\b"


def _g(pattern: str, n: int, ignore_case: bool = False) -> TextFn:
    regex = T.js(pattern, ignore_case)
    return lambda m: F.regexp_extract(m, regex, n)


def _english_number(m: Column) -> Column:
    return F.translate(m, ",.", ".,")


def _passive_skip(span: Column, text: Column) -> Column:
    def no_verb(verb: Column) -> Column:
        is_verb = verb.isin(PASSIVE_VERBS) | ((F.length(verb) >= 5) & F.endswith(verb, F.lit("kan")))
        return verb.isin(LOCATIVES) | ~is_verb

    return T.let(F.lower(_g(_SPLIT_DI, 2)(span["text"])), no_verb)


def _two_words(rule_id: str, pattern: str, joined: str) -> Rule:
    apart = pattern.replace(r"\s+", " ").replace(r"\b", "")
    return Rule(
        rule_id, "error", pattern,
        _const(f'"{apart}" ditulis serangkai sebagai "{joined}".'),
        _const(joined), ignore_case=True,
    )


# Rule ids, severities, patterns and messages.
RULES: tuple[Rule, ...] = (
    Rule(
        "eyd.double-space", "warning", f"{_L}  +{_L}",
        _const("Dua spasi atau lebih berturut-turut antara kata."),
        lambda m: F.regexp_replace(m, " +", " "),
        gate=_holds("  "),
    ),
    Rule(
        "eyd.space-before-punct", "warning", rf"{_L}\s{{2,}}([,.;:!?])",
        _const("Tidak boleh ada spasi sebelum tanda baca."),
        lambda m: F.regexp_replace(m, T.WS + "+", ""),
        skip=_leader_dot, gate=_matches(r"\s\s[,.;:!?]"),
    ),
    Rule(
        "eyd.missing-space-after-punct", "warning", rf"{_L}{{2,}}([,.;:!?]){_L}{{2,}}",
        lambda m: F.concat(
            F.lit('Tidak ada spasi setelah tanda "'), F.regexp_extract(m, "[,.;:!?]", 0), F.lit('".')
        ),
        lambda m: F.regexp_replace(m, "([,.;:!?])", "$1 "),
        gate=_matches(f"[,.;:!?]{_L}{_L}"),
    ),
    Rule(
        "eyd.repeated-punct", "warning", r"([,;:!?])\1+",
        lambda m: F.concat(F.lit('Tanda "'), F.left(m, F.lit(1)), F.lit('" berulang.')),
        lambda m: F.left(m, F.lit(1)),
        gate=_holds(",,", ";;", "::", "!!", "??"),
    ),
    Rule(
        "eyd.repeated-period", "warning", r"\.{2,}",
        _const("Tanda titik berulang. Gunakan satu titik (.) atau elipsis tiga titik (...)."),
        lambda m: F.when(F.length(m) == 2, ".").otherwise("..."),
        skip=lambda s, t: (F.length(s["text"]) == 3) | (F.length(s["text"]) >= 6), gate=_holds(".."),
    ),
    Rule(
        "eyd.english-number-format", "info", _NUMBER,
        _const(
            "Format angka tampak gaya Inggris. Indonesia: titik untuk ribuan (1.000), "
            "koma untuk desimal (12,5)."
        ),
        _english_number,
        gate=_matches(r"\d,\d\d\d"),
    ),
    Rule(
        "eyd.di-locative-one-word", "error", _DI,
        lambda m: F.concat(
            F.lit('"'), F.lower(m), F.lit('" ditulis terpisah sebagai "di '),
            F.substring(F.lower(m), 3, 1000), F.lit('" (kata depan + kata benda/lokasi).'),
        ),
        lambda m: F.concat(F.lit("di "), F.substring(F.lower(m), 3, 1000)),
        ignore_case=True,
    ),
    Rule(
        "eyd.kemana-one-word", "error", r"\bkemana\b",
        _const('"kemana" ditulis terpisah sebagai "ke mana".'),
        _const("ke mana"), ignore_case=True,
    ),
    _two_words("eyd.daripada-two-words", r"\bdari\s+pada\b", "daripada"),
    _two_words("eyd.kepada-two-words", r"\bke\s+pada\b", "kepada"),
    _two_words("eyd.bagaimana-two-words", r"\bbagai\s+mana\b", "bagaimana"),
    _two_words("eyd.ketika-two-words", r"\bke\s+tika\b", "ketika"),
    Rule(
        "eyd.particle-lah-separated", "error", _LAH,
        lambda m: F.concat(
            F.lit('Partikel "-'), _g(_LAH, 2)(m),
            F.lit('" ditulis serangkai dengan kata sebelumnya, contoh "'),
            _g(_LAH, 1)(m), _g(_LAH, 2)(m), F.lit('".'),
        ),
        lambda m: F.concat(_g(_LAH, 1)(m), _g(_LAH, 2)(m)),
        gate=_matches(r"\s[lkt]ah"),
    ),
    Rule(
        "eyd.particle-pun-attached", "error", _PUN,
        lambda m: F.concat(
            F.lit('Partikel "pun" ditulis terpisah ("'), _g(_PUN, 1)(m),
            F.lit(' pun"), kecuali pada bentuk tetap seperti walaupun, meskipun, adapun, maupun.'),
        ),
        lambda m: F.concat(_g(_PUN, 1)(m), F.lit(" pun")),
        skip=lambda s, t: F.lower(s["text"]).isin(PUN_FIXED), gate=_holds("pun"),
    ),
    Rule(
        "eyd.di-passive-split", "warning", _SPLIT_DI,
        lambda m: F.concat(
            F.lit('Prefiks pasif "di-" ditulis serangkai dengan kata kerja, contoh "di'),
            _g(_SPLIT_DI, 2)(m), F.lit('".'),
        ),
        lambda m: F.concat(_g(_SPLIT_DI, 1)(m), _g(_SPLIT_DI, 2)(m)),
        skip=_passive_skip, gate=_matches(r"[dD]i\s"),
    ),
)


class RuleRegistry:
    """Rules by id; callers add their own."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self._rules = {r.id: r for r in rules}

    def register(self, rule: Rule) -> "RuleRegistry":
        if rule.id in self._rules:
            raise ValueError(f"rule {rule.id} exists")
        self._rules[rule.id] = rule
        return self

    def select(self, *ids: str) -> tuple[Rule, ...]:
        return tuple(self._rules[i] for i in ids) if ids else tuple(self._rules.values())


def rule_hits(text: Column, skip_ranges: Column, rules: Sequence[Rule]) -> Column:
    """Array of rule hits of one page, skip ranges and rule exceptions already applied."""
    kinds = {"rule_id": "string", "severity": "string", "offset": "int", "length": "int", "token": "string", "message": "string", "suggestion": "string"}
    nothing = F.array().cast(f"array<struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>>")

    def hits(rule: Rule) -> Column:
        found = T.spans(text, rule.regex)
        if rule.skip is not None:
            exception = rule.skip
            found = F.filter(found, lambda s: ~exception(s, text))
        found = F.transform(
            found,
            lambda s: F.struct(
                F.lit(rule.id).alias("rule_id"),
                F.lit(rule.severity).alias("severity"),
                s["start"].alias("offset"),
                (s["end"] - s["start"]).alias("length"),
                s["text"].alias("token"),
                rule.message(s["text"]).alias("message"),
                rule.suggestion(s["text"]).alias("suggestion"),
            ),
        )
        return found if rule.gate is None else F.when(rule.gate(text), found).otherwise(nothing)

    def outside(found: Column) -> Column:
        kept = T.let(
            skip_ranges,
            lambda skip: F.filter(found, lambda h: ~T.overlaps(h["offset"], h["offset"] + h["length"], skip)),
        )
        # a page without hits needs no ranges
        return F.when(F.size(found) > 0, kept).otherwise(found)

    return T.let(F.concat(*[hits(r) for r in rules]), outside)


def scan_rules(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    skip_ranges: Column | None = None,
    links: bool = False,
) -> DataFrame:
    """One row per hit. Pages need ``job_id, page_number, content``.

    Hits that meet ``skip_ranges`` (or, with ``links``, a link) are left out. The rules of this module are
    looked for over blocks of pages (``rule_scan``), those that a caller has made by ``rule_hits`` in each row.
    """
    own = [r for r in rules if any(r is x for x in RULES)]
    rest = [r for r in rules if not any(r is x for x in RULES)]
    skip = T.no_ranges() if skip_ranges is None else skip_ranges
    parts = []
    if own:
        parts.append(_scan_blocks(pages, own, skip, links))
    if rest:
        parts.append(_scan_rows(pages, rest, F.concat(skip, link_ranges(F.col("content"))) if links else skip))
    return reduce(DataFrame.unionByName, parts)


def _scan_rows(pages: DataFrame, rules: Sequence[Rule], skip: Column) -> DataFrame:
    text = F.col("content")
    return pages.select(
        "job_id", "page_number", "content", F.explode(rule_hits(text, skip, rules)).alias("h")
    ).select(
        "job_id",
        "page_number",
        "h.*",
        T.excerpt(text, F.col("h.offset"), F.col("h.offset") + F.col("h.length")).alias("excerpt"),
    )


def _scan_blocks(pages: DataFrame, rules: Sequence[Rule], skip: Column, links: bool) -> DataFrame:
    patterns = [(r.id, RS.python_regex(r.pattern, r.ignore_case)) for r in rules]
    link = RS.python_regex(URL, True) if links else None
    kinds = ", ".join(f"{x} {pages.schema[x].dataType.simpleString()}" for x in ("job_id", "page_number"))
    found = pages.select("job_id", "page_number", "content", skip.alias("skip")).mapInArrow(
        lambda batches: RS.scan(batches, patterns, link),
        f"{kinds}, rule_id string, offset int, length int, token string, around string",
    )

    def by_rule(value: Callable[[Rule], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("rule_id") == r.id, value(r)) for r in rules])

    return found.select(
        "job_id", "page_number", "rule_id",
        by_rule(lambda r: F.lit(r.severity)).alias("severity"), "offset", "length", "token",
        by_rule(lambda r: r.message(F.col("token"))).alias("message"),
        by_rule(lambda r: r.suggestion(F.col("token"))).alias("suggestion"),
        T.squeeze(F.col("around")).alias("excerpt"),
    )


def page_skip_ranges(content: Column, code_json: Column) -> Column:
    """Stored code ranges and link ranges of a page."""
    return F.concat(T.parse_ranges(code_json), link_ranges(content))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per page, offset and rule (identical rows of one scan)."""
    return findings.dropDuplicates(["job_id", "page_number", "offset", "rule_id"])
