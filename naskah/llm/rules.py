"""Quality rules as a short-circuit cascade.

A rule compares measures of a text with fixed thresholds and rejects it or not. Measures build on
each other (words, lines, windows of words), so a rule costs what its measures cost that nothing
before it has taken. ``plan`` takes the time of every measure and the verdict of every rule on a
sample and orders the rules greedily by rejections per cost, counted among the sampled texts that
the rules chosen so far let pass. ``cascade`` applies the rules in that order: a rejected text
takes no further measures.

The verdict is the conjunction of all rules, so neither the order nor the sample changes it; only
``rejected_by`` (the first rule of the order that rejects) depends on it. The sample has about
``SAMPLE_ROWS`` rows; of it the driver sees one sum per measure and one count per combination of
verdicts. Everything else is one pass over the rows without a shuffle, in blocks of texts.

Defined results: null text counts as empty; empty texts have no words and fail ``few_words``.
Repeated rows and keys are judged row by row, null keys are kept, other columns are ignored, an
empty table gives no rows. Texts are taken whole, however long.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.llm import text as T

SAMPLE_ROWS = 2000
SAMPLE_SEED = 7
SYMBOLS = b"#*$%&|<>"

_U64 = np.uint64


def _class(members: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SYMBOL = _class(SYMBOLS)
_DIGIT = _class(b"0123456789")
_EXCLAIM = _class(b"!")
_UPPER = _class(range(65, 91))
_LOWER = _class(range(97, 123))
_LETTER = _class([*range(65, 91), *range(97, 123), *range(128, 256)])
_LEAD = _class([*range(128), *range(192, 256)])  # first bytes of code points
_IN_WORDS = _LEAD & ~T.IS_SPACE


class Texts:
    """Rows of a block and the measures taken of them so far."""

    def __init__(self, block: T.Block):
        self.block = block
        self.have: dict[str, object] = {}

    def get(self, name: str):
        if name not in self.have:
            self.have[name] = MEASURES[name].take(self)
        return self.have[name]

    def keep(self, rows: np.ndarray) -> Texts:
        """The texts of ``rows`` (ascending row numbers) with what is known of them."""
        b = self.block
        at = _ranges(b.starts[rows], b.ends[rows])
        ends = np.cumsum(b.ends[rows] - b.starts[rows])
        out = Texts(T.Block(b.rows, b.data[at], ends - (b.ends[rows] - b.starts[rows]), ends))
        for name, value in self.have.items():
            out.have[name] = _keep_words(value, rows, b, out.block) if isinstance(value, T.Words) else value[rows]
        return out

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes per row that are in ``table``."""
        sums = np.concatenate([[0], np.cumsum(table[self.block.data], dtype=np.int64)])
        return sums[self.block.ends] - sums[self.block.starts]

    def count_words(self, *tests: tuple[np.ndarray, int, int]) -> np.ndarray:
        """Words per row with between low and high bytes of every class (table, low, high)."""
        w = self.get("words")
        good = np.ones(len(w.starts), bool)
        for table, low, high in tests:
            sums = np.concatenate([[0], np.cumsum(table[self.block.data], dtype=np.int64)])
            n = sums[w.ends] - sums[w.starts]
            good &= (n >= low) & (n <= high)
        return _per_row(good, w.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, row, how often the window occurs in its row) of all windows of words."""
        w = self.get("words")
        rows = T.row_of(w.first)
        n = max(len(rows) - size + 1, 0)
        start = np.flatnonzero(rows[:n] == rows[len(rows) - n :])
        hashes = np.zeros(n, _U64)
        for k in range(size):
            hashes += w.hashes[k : k + n] * T.LANES[k]
        keys = T.mix(T.mix(hashes[start]) + rows[start].astype(_U64) * _U64(T.BASE))
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(new) - 1
        times = np.empty(len(keys), np.int64)
        times[order] = np.bincount(group, minlength=1)[group] if len(keys) else 0
        return start, rows[start], times

    def repeated(self, size: int) -> np.ndarray:
        """Words per row inside a window of ``size`` words that occurs twice or more."""
        w = self.get("words")
        start, _, times = self.windows(size)
        ends = np.zeros(len(w.hashes) + 1, np.int64)
        twice = start[times > 1]
        np.add.at(ends, twice, 1)
        np.add.at(ends, twice + size, -1)
        return _per_row(np.cumsum(ends[:-1]) > 0, w.first)

    def most_frequent(self, size: int) -> np.ndarray:
        """How often a row's most frequent window of ``size`` words occurs."""
        _, rows, times = self.windows(size)
        out = np.zeros(len(self.block.starts), np.int64)
        np.maximum.at(out, rows, times)
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row: lines with a word, and those of them that equal an earlier one."""
        b = self.block
        cuts = np.flatnonzero(b.data == 10)
        starts = np.sort(np.concatenate([b.starts, cuts + 1]))
        ends = np.sort(np.concatenate([b.ends, cuts]))
        # rows and line feeds alternate alike in both, so the i-th start belongs to the i-th end
        rows = np.searchsorted(b.ends, ends, "left")
        inside = np.concatenate([[0], np.cumsum(~T.IS_SPACE[b.data], dtype=np.int64)])
        full = inside[ends] > inside[starts]
        starts, ends, rows = starts[full], ends[full], rows[full]
        p = T.prefix_hash(T.BYTE_VALUES[b.data])
        back = T.powers(T.BASE_INVERSE, len(b.data) + 1)
        keys = T.mix(T.mix((p[ends] - p[starts]) * back[starts]) + rows.astype(_U64) * _U64(T.BASE))
        n = np.bincount(rows, minlength=len(b.starts))
        first = np.unique(keys, return_index=True)[1]
        return n, n - np.bincount(rows[first], minlength=len(b.starts))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one after the other."""
    sizes = ends - starts
    to = np.cumsum(sizes)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def _keep_words(w: T.Words, rows: np.ndarray, old: T.Block, new: T.Block) -> T.Words:
    counts = np.diff(w.first)[rows]
    at = _ranges(w.first[rows], w.first[rows] + counts)
    moved = np.repeat(new.starts - old.starts[rows], counts)
    return T.Words(w.starts[at] + moved, w.ends[at] + moved, w.hashes[at], np.concatenate([[0], np.cumsum(counts)]))


class Measure(NamedTuple):
    needs: tuple[str, ...]  # other measures it reads
    take: Callable[[Texts], object]


MEASURES: dict[str, Measure] = {
    "words": Measure((), lambda t: T.words(t.block, T.BYTE_VALUES)),
    "lines": Measure((), lambda t: np.stack(t.lines(), axis=1)),
    "n_words": Measure(("words",), lambda t: np.diff(t.get("words").first)),
    "word_chars": Measure((), lambda t: t.count(_IN_WORDS)),
    "n_symbols": Measure((), lambda t: t.count(_SYMBOL)),
    "n_digits": Measure((), lambda t: t.count(_DIGIT)),
    "n_exclaims": Measure((), lambda t: t.count(_EXCLAIM)),
    "n_lines": Measure(("lines",), lambda t: t.get("lines")[:, 0]),
    "n_dup_lines": Measure(("lines",), lambda t: t.get("lines")[:, 1]),
    "n_upper_words": Measure(("words",), lambda t: t.count_words((_UPPER, 2, 1 << 62), (_LOWER, 0, 0))),
    "n_letter_words": Measure(("words",), lambda t: t.count_words((_LETTER, 1, 1 << 62))),
    "n_repeat_words": Measure(("words",), lambda t: t.repeated(3)),
    "n_repeat_5": Measure(("words",), lambda t: t.repeated(5)),
    "top_pair": Measure(("words",), lambda t: t.most_frequent(2)),
}


class Test(NamedTuple):
    """``a * left > b * right``; without ``right``, ``a * left > b``."""

    a: int
    left: str
    b: int
    right: str | None = None

    def holds(self, t: Texts) -> np.ndarray:
        return self.a * t.get(self.left) > self.b * (t.get(self.right) if self.right else 1)

    def sql(self) -> str:
        return f"{self.a} * {self.left} > {self.b}" + (f" * {self.right}" if self.right else "")


class Rule(NamedTuple):
    """Rejects a text if one of its tests holds."""

    name: str
    tests: tuple[Test, ...]

    @property
    def needs(self) -> list[str]:
        return sorted({m for test in self.tests for m in (test.left, test.right) if m})

    def rejects(self, t: Texts) -> np.ndarray:
        return np.logical_or.reduce([test.holds(t) for test in self.tests])

    def sql(self) -> str:
        return " OR ".join(test.sql() for test in self.tests)


#: Rejected before the cascade.
BASE = (
    Rule("few_words", (Test(-1, "n_words", -50),)),
    Rule("repeated_windows", (Test(100, "n_repeat_words", 50, "n_words"),)),
)
RULES = (
    Rule("symbols", (Test(10, "n_symbols", 1, "n_words"),)),
    Rule("word_length", (Test(-1, "word_chars", -3, "n_words"), Test(1, "word_chars", 10, "n_words"))),
    Rule("digits", (Test(5, "n_digits", 1, "word_chars"),)),
    Rule("exclaims", (Test(10, "n_exclaims", 1, "n_words"),)),
    Rule("equal_lines", (Test(10, "n_dup_lines", 4, "n_lines"),)),
    Rule("upper_case", (Test(10, "n_upper_words", 3, "n_words"),)),
    Rule("no_letters", (Test(-10, "n_letter_words", -8, "n_words"),)),
    Rule("frequent_pair", (Test(10, "top_pair", 1, "n_words"),)),
    Rule("long_repeats", (Test(10, "n_repeat_5", 3, "n_words"),)),
)
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _closure(names: Iterable[str]) -> set[str]:
    out: set[str] = set()
    for name in names:
        out |= {name} | _closure(MEASURES[name].needs)
    return out


def order_rules(rules: Sequence[Rule], costs: dict[str, float], verdicts: dict[int, int], known: Iterable[str] = ()) -> list[Rule]:
    """Rules by rejections per cost, each counted among the texts that the earlier ones pass.

    ``verdicts`` counts sampled texts per bit mask of rejecting rules, ``costs`` is the time of
    each measure and of each rule's comparison; measures in ``known`` are free. Rules that reject
    nothing more come last, the cheapest first; ties go to the earlier rule.
    """
    taken, left, out = _closure(known), list(range(len(rules))), []
    while left:
        def rate(i: int) -> tuple[float, float]:
            cost = costs.get(rules[i].name, 0) + sum(costs.get(m, 0) for m in _closure(rules[i].needs) - taken)
            hits = sum(n for mask, n in verdicts.items() if mask >> i & 1)
            return hits / max(cost, 1e-9), -cost

        best = max(left, key=lambda i: (*rate(i), -i))
        verdicts = {mask: n for mask, n in verdicts.items() if not mask >> best & 1}
        taken |= _closure(rules[best].needs)
        left.remove(best)
        out.append(rules[best])
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", known: Sequence[str] = (),
         first: Sequence[Rule] = (), sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The order of ``rules`` for ``docs``, from about ``sample_rows`` of its rows.

    Texts that a rule of ``first`` rejects never reach the cascade and do not count.
    """
    names = sorted(_closure(m for r in (*first, *rules) for m in r.needs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent: dict[str, int] = {}
        masks: dict[int, int] = {}
        for batch in batches:
            for block in T.blocks(batch.column(0)):
                t, todo = Texts(block), list(names)
                while todo:  # what a measure reads is taken, and timed, before it
                    name = next(m for m in todo if all(n in t.have for n in MEASURES[m].needs))
                    todo.remove(name)
                    at = time.perf_counter_ns()
                    t.get(name)
                    spent[name] = spent.get(name, 0) + time.perf_counter_ns() - at
                mask = np.zeros(len(block.starts), np.int64)
                for i, rule in enumerate(rules):
                    at = time.perf_counter_ns()
                    mask |= rule.rejects(t).astype(np.int64) << i
                    spent[rule.name] = spent.get(rule.name, 0) + time.perf_counter_ns() - at
                reached = np.ones(len(mask), bool)
                for rule in first:
                    reached &= ~rule.rejects(t)
                for m, n in zip(*np.unique(mask[reached], return_counts=True), strict=True):
                    masks[int(m)] = masks.get(int(m), 0) + int(n)
        yield pa.RecordBatch.from_pydict({
            "measure": pa.array([*spent, *[None] * len(masks)], pa.string()),
            "mask": pa.array([*[None] * len(spent), *masks], pa.int64()),
            "n": pa.array([*spent.values(), *masks.values()], pa.int64()),
        })

    n = docs.count()
    sample = docs.select(text_col)
    if n > sample_rows:
        sample = sample.sample(sample_rows / n, SAMPLE_SEED)
    seen = sample.mapInArrow(measure, "measure string, mask long, n long").groupBy("measure", "mask").agg(F.sum("n").alias("n")).collect()
    costs = {r["measure"]: float(r["n"]) for r in seen if r["measure"] is not None}
    return order_rules(rules, costs, {r["mask"]: r["n"] for r in seen if r["mask"] is not None}, known)


def judge(t: Texts, ordered: Sequence[Rule]) -> np.ndarray:
    """Per row the number of the first rejecting rule, -1 if none; rejected rows leave at once."""
    verdict, alive = np.full(len(t.block.starts), -1), np.arange(len(t.block.starts))
    for i, rule in enumerate(ordered):
        bad = rule.rejects(t)
        if bad.any():
            verdict[alive[bad]] = i
            good = np.flatnonzero(~bad)
            alive = alive[good]
            if not len(alive):
                break
            t = t.keep(good)
    return verdict


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", measures: Sequence[str] = (),
            first: Sequence[Rule] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns of ``docs`` but the text, ``measures`` of every row, ``base_failed`` (a rule of ``first``
    rejects), ``kept`` (no rule rejects) and ``rejected_by``.

    ``measures`` and ``first`` are taken of all rows; the rules follow in the planned order.
    Columns of ``docs`` with one of these names are left out.
    """
    added = [*measures, "base_failed", "kept", "rejected_by"]
    others = [c for c in docs.columns if c != text_col and c not in added]
    ordered = plan(docs, rules, text_col, [*measures, *[m for r in first for m in r.needs]], first, sample_rows)
    labels = np.array([r.name for r in (*first, *ordered)], object)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column(text_col)):
                t = Texts(block)
                columns = [np.asarray(t.get(m), np.int64) for m in measures]
                verdict = np.full(len(block.starts), -1)
                for i, rule in enumerate(first):
                    verdict = np.where((verdict < 0) & rule.rejects(t), i, verdict)
                failed = verdict >= 0
                rest = np.flatnonzero(~failed)
                if len(rest):
                    late = judge(t if len(rest) == len(failed) else t.keep(rest), ordered)
                    verdict[rest] = np.where(late < 0, -1, late + len(first))
                part = batch.slice(block.rows.start, len(failed))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in others]
                    + [pa.array(c) for c in columns]
                    + [pa.array(failed), pa.array(verdict < 0), pa.array(np.where(verdict < 0, None, labels[verdict]), pa.string())],
                    [*others, *added],
                )

    kinds = [docs.schema[c] for c in others]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    own = ", ".join([f"{m} long" for m in measures] + ["base_failed boolean", "kept boolean", "rejected_by string"])
    return docs.select(*others, text_col).mapInArrow(apply, f"{schema}, {own}" if schema else own)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures, ``base_failed`` and verdict of every document."""
    out = cascade(docs.select("doc_id", "text"), measures=CONTRACT, first=BASE)
    return out.select("doc_id", *CONTRACT, "base_failed", "kept")


def oracle_sql() -> str:
    """The same rows in SQL: all rules on all texts, without an order."""

    def repeated(size: int) -> str:
        window = ", ".join(["w", *[f"lead(w, {k}) OVER win" for k in range(1, size)]])
        last = f"lead(w, {size - 1}) OVER win"
        return f"""(SELECT rid, count(*) FILTER (inside) AS n FROM (
            SELECT rid, max(often) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) > 1 AS inside
            FROM (SELECT rid, i, CASE WHEN whole THEN count(*) OVER (PARTITION BY rid, g) ELSE 0 END AS often
                  FROM (SELECT rid, i, [{window}] AS g, {last} IS NOT NULL AS whole FROM words WINDOW win AS (PARTITION BY rid ORDER BY i)))
        ) GROUP BY rid)"""

    base = " OR ".join(f"({r.sql()})" for r in BASE)
    rest = " OR ".join(f"({r.sql()})" for r in RULES)
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
    per_word AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars,
                 count(*) FILTER (regexp_matches(w, '[A-Z].*[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_upper_words,
                 count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS n_letter_words
                 FROM words GROUP BY rid),
    per_line AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
                 FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
                 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
    pairs AS (SELECT rid, max(n) AS n FROM (SELECT rid, w, v, count(*) AS n FROM (
                  SELECT rid, w, lead(w) OVER (PARTITION BY rid ORDER BY i) AS v FROM words) WHERE v IS NOT NULL GROUP BY ALL) GROUP BY rid),
    measured AS (
        SELECT doc_id, coalesce(p.n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
               coalesce(n_upper_words, 0) AS n_upper_words, coalesce(n_letter_words, 0) AS n_letter_words,
               coalesce(r3.n, 0) AS n_repeat_words, coalesce(r5.n, 0) AS n_repeat_5, coalesce(pairs.n, 0) AS top_pair
        FROM docs LEFT JOIN per_word p USING (rid) LEFT JOIN per_line USING (rid) LEFT JOIN pairs USING (rid)
        LEFT JOIN {repeated(3)} r3 USING (rid) LEFT JOIN {repeated(5)} r5 USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({base}) AS base_failed, NOT ({base}) AND NOT ({rest}) AS kept
    FROM measured"""
