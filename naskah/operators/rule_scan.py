"""The pattern rules over blocks of pages, inside tasks.

``rules.rule_hits`` says what a hit is. Here the pages of an Arrow batch are joined into one string with
a character between them that no rule matches; places where a rule may begin come from array operations
over the characters of the whole block, and its pattern is only tried there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from naskah.constants import LOCATIVES, PASSIVE_VERBS, PUN_FIXED
from naskah.functions import text as T

BLOCK_CHARS = 1 << 20
MARGIN = 30  # characters on both sides of a hit
_GAP = "\0"
_PAD = 4
_LETTER, _BLANK, _POINT, _DIGIT, _WORD = 1, 2, 4, 8, 16


def python_regex(pattern: str, ignore_case: bool = False) -> re.Pattern:
    r"""``pattern`` of ``T.js`` for Python: ``\s``, ``\d`` and ``\w`` are ASCII, other letters still have two cases."""
    text = T.js(pattern).replace(r"\s", r" \t\n\x0b\f\r")
    return re.compile(text, re.IGNORECASE if ignore_case else re.ASCII)


def _kinds() -> np.ndarray:
    kinds = np.zeros(65536, np.uint8)
    for bit, rx in (
        (_LETTER, re.compile("[A-Za-zÀ-ÿ]")), (_BLANK, python_regex(T.WS)), (_POINT, re.compile("[,.;:!?]")),
        (_DIGIT, re.compile("[0-9]")), (_WORD, re.compile("[A-Za-z0-9_]")),
    ):
        kinds[[i for i in range(65536) if rx.match(chr(i))]] |= bit
    return kinds


_KINDS = _kinds()
# One byte a character: ASCII as it is, the other cases of i and k, and one value for the rest.
_OTHER_CASES = {"ı": 0x80, "İ": 0x81, "\u212a": 0x82}
_BYTES = np.full(65536, 0xFF, np.uint8)
_BYTES[:128] = np.arange(128)
_BYTES[[ord(x) for x in _OTHER_CASES]] = list(_OTHER_CASES.values())


class Block(NamedTuple):
    text: str
    data: np.ndarray  # a byte per character, by _BYTES
    kinds: np.ndarray
    runs: dict[int, np.ndarray]  # first places of the runs of a kind, once asked for

    def has(self, bit: int, shift: int = 0) -> np.ndarray:
        """Whether the character ``shift`` places on has this kind, for all but the padding."""
        return (self.kinds[_PAD + shift : len(self.kinds) - _PAD + shift] & bit) != 0

    def holds(self, letters: str, shift: int = 0) -> np.ndarray:
        part = self.data[_PAD + shift : len(self.data) - _PAD + shift]
        codes = [int(_BYTES[ord(x)]) for x in letters]
        out = part == codes[0]
        for x in codes[1:]:
            out |= part == x
        return out

    def run_starts(self, bit: int, at: np.ndarray) -> np.ndarray:
        """The first place of the run of this kind that holds each of ``at``."""
        if not len(at):
            return at
        if bit not in self.runs:
            inside = (self.kinds & bit) != 0
            self.runs[bit] = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        first = self.runs[bit]
        return first[np.searchsorted(first, at, "right") - 1]


def block_of(texts: list[str]) -> tuple[Block, np.ndarray]:
    """The texts as one block, and where each begins in it."""
    text = _GAP * _PAD + _GAP.join(texts) + _GAP * _PAD
    if text.isascii():
        data = np.frombuffer(text.encode(), np.uint8)
        kinds = _KINDS[data]
    else:
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)
        data, kinds = _BYTES[points], _KINDS[points]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return Block(text, data, kinds, {}), _PAD + np.cumsum(sizes) - sizes


def _at(mask: np.ndarray, shift: int = 0) -> np.ndarray:
    return np.flatnonzero(mask) + (_PAD + shift)


def _after_letter(b: Block) -> np.ndarray:
    return _at(b.has(_LETTER) & b.has(_BLANK, 1) & b.has(_BLANK, 2))


def _missing_space(b: Block) -> np.ndarray:
    points = b.has(_POINT) & b.has(_LETTER, -1) & b.has(_LETTER, -2) & b.has(_LETTER, 1) & b.has(_LETTER, 2)
    return b.run_starts(_LETTER, _at(points) - 1)


def _repeated(letters: str) -> Callable[[Block], np.ndarray]:
    def starts(b: Block) -> np.ndarray:
        inner = b.data[_PAD:-_PAD]
        return _at(b.holds(letters) & (inner == b.data[_PAD + 1 : len(b.data) - _PAD + 1]) & (inner != b.data[_PAD - 1 : len(b.data) - _PAD - 1]))

    return starts


def _number(b: Block) -> np.ndarray:
    commas = b.holds(",") & b.has(_DIGIT, -1) & b.has(_DIGIT, 1) & b.has(_DIGIT, 2) & b.has(_DIGIT, 3)
    return b.run_starts(_WORD, _at(commas) - 1)


def _begins(*letters: str) -> Callable[[Block], np.ndarray]:
    """Words that begin with these letters; each of them is given in all its cases, an empty one is a blank."""

    def starts(b: Block) -> np.ndarray:
        out = ~b.has(_WORD, -1)
        for i, x in enumerate(letters):
            out &= b.holds(x, i) if x else b.has(_BLANK, i)
        return _at(out)

    return starts


def _particle(b: Block) -> np.ndarray:
    at = _at(b.has(_BLANK, -1) & b.holds("lkt") & b.holds("a", 1) & b.holds("h", 2) & ~b.has(_WORD, 3))
    words = b.run_starts(_BLANK, at - 1) - 1
    return b.run_starts(_WORD, words[(b.kinds[words] & _WORD) != 0])


def _pun(b: Block) -> np.ndarray:
    """Word boundaries within runs of letters that hold ``pun`` at the end of a word."""
    ends = _at(b.holds("p") & b.holds("u", 1) & b.holds("n", 2) & ~b.has(_WORD, 3))
    if not len(ends):
        return ends
    word = (b.kinds & _WORD) != 0
    edges = np.flatnonzero((word[1:] != word[:-1]) & ((b.kinds[1:] & _LETTER) != 0)) + 1
    return edges[np.isin(b.run_starts(_LETTER, edges), b.run_starts(_LETTER, ends))]


def _leader_dot(text: str, start: int, end: int) -> bool:
    if text[end - 1] != ".":
        return False
    if text[end] == "." or text[end : end + 2] == " .":
        return True
    at = end - 2
    while text[at] == " ":
        at -= 1
    return text[at] == "."


_SPLIT_DI = python_regex(r"\b(di|Di)\s+([a-zà-ÿ]{3,})\b")


def _no_passive(text: str, start: int, end: int) -> bool:
    found = _SPLIT_DI.search(text[start:end])
    verb = found.group(2).lower() if found else ""
    return verb in LOCATIVES or not (verb in PASSIVE_VERBS or (len(verb) >= 5 and verb.endswith("kan")))


class Finder(NamedTuple):
    """Where a rule may begin in a block, in rising order, and which of its matches it leaves out."""

    starts: Callable[[Block], np.ndarray]
    skip: Callable[[str, int, int], bool] | None = None


# "ı" and "İ" are cases of i, "K" of k.
_I, _K = "iIıİ", "kKK"
FINDERS: dict[str, Finder] = {
    "eyd.double-space": Finder(lambda b: _at(b.has(_LETTER) & b.holds(" ", 1) & b.holds(" ", 2))),
    "eyd.space-before-punct": Finder(_after_letter, _leader_dot),
    "eyd.missing-space-after-punct": Finder(_missing_space),
    "eyd.repeated-punct": Finder(_repeated(",;:!?")),
    "eyd.repeated-period": Finder(_repeated("."), lambda text, s, e: e - s == 3 or e - s >= 6),
    "eyd.english-number-format": Finder(_number),
    "eyd.di-locative-one-word": Finder(_begins("dD", _I)),
    "eyd.kemana-one-word": Finder(_begins(_K, "eE", "mM")),
    "eyd.daripada-two-words": Finder(_begins("dD", "aA", "rR")),
    "eyd.kepada-two-words": Finder(_begins(_K, "eE", "")),
    "eyd.bagaimana-two-words": Finder(_begins("bB", "aA", "gG")),
    "eyd.ketika-two-words": Finder(_begins(_K, "eE", "")),
    "eyd.particle-lah-separated": Finder(_particle),
    "eyd.particle-pun-attached": Finder(_pun, lambda text, s, e: text[s:e].lower() in PUN_FIXED),
    "eyd.di-passive-split": Finder(_begins("dD", "i", ""), _no_passive),
}


def matches(block: Block, finder: Finder, regex: re.Pattern) -> list[tuple[int, int]]:
    """Matches of a rule from left to right, none inside an earlier one."""
    out: list[tuple[int, int]] = []
    last, text, skip = 0, block.text, finder.skip
    for start in finder.starts(block).tolist():
        if start >= last and (found := regex.match(text, start)):
            last = found.end()
            if skip is None or not skip(text, start, last):
                out.append((start, last))
    return out


def link_ranges(b: Block, begin: np.ndarray, link: re.Pattern) -> dict[int, list[tuple[int, int]]]:
    """Links of each text of a block, looked for in runs without blanks that may hold one.

    Such a run has ``://``, ``www.`` or a period before the first letter of a host's end.
    """
    sign = b.holds(":") & b.holds("/", 1) & b.holds("/", 2)
    sign |= b.holds("wW") & b.holds("wW", 1) & b.holds("wW", 2) & b.holds(".", 3)
    sign |= b.holds(".") & b.holds("cConNaAlLgGO" + _I, 1)
    at = _at(sign)
    if not len(at):
        return {}
    page = np.searchsorted(begin, at, "right") - 1
    stops = np.append(begin[1:], len(b.text) - _PAD + 1) - 1
    blanks = np.concatenate([[0], np.flatnonzero(b.kinds & _BLANK), [len(b.text)]])
    after = np.searchsorted(blanks, at)
    first, last = np.maximum(blanks[after - 1] + 1, begin[page]), np.minimum(blanks[after], stops[page])
    out: dict[int, list[tuple[int, int]]] = {}
    for lo, hi, p, origin in sorted(set(zip(first.tolist(), last.tolist(), page.tolist(), begin[page].tolist()))):
        found = [(lo - origin + m.start(), lo - origin + m.end()) for m in link.finditer(b.text[lo:hi])]
        out.setdefault(p, []).extend(found)
    return out


def scan(
    batches: Iterator[pa.RecordBatch], rules: list[tuple[str, re.Pattern]], link: re.Pattern | None
) -> Iterator[pa.RecordBatch]:
    """Hits of batches of ``job_id, page_number, content, skip``, ranges to leave out applied.

    A range whose bounds are unknown, or no list of ranges at all, leaves out what it may cover.
    """
    names = pa.array([name for name, _ in rules], pa.string())
    for batch in batches:
        texts, skips = batch.column(2).to_pylist(), batch.column(3)
        at, size = 0, 0
        for i in range(len(texts)):
            texts[i] = texts[i] or ""
            size += len(texts[i])
            if size < BLOCK_CHARS and i + 1 < len(texts):
                continue
            yield _hits(batch, at, texts[at : i + 1], skips, names, rules, link)
            at, size = i + 1, 0


def _hits(batch, at, texts, skips, names, rules, link) -> pa.RecordBatch:
    block, begin = block_of(texts)
    spans = [(s, e, k) for k, (name, regex) in enumerate(rules) for s, e in matches(block, FINDERS[name], regex)]
    found = np.array(spans, np.int64).reshape(-1, 3)
    page = np.searchsorted(begin, found[:, 0], "right") - 1
    held: dict[int, list | None] = {}
    links = link_ranges(block, begin, link) if link is not None else {}
    kept = []
    lists = skips.slice(at, len(texts))
    known = lists.is_valid().to_pylist()
    flat = lists.flatten()
    stored = list(zip(*(pc.struct_field(flat, k).to_pylist() for k in (0, 1))))
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).tolist()
    for i, (p, origin, (s, e, _)) in enumerate(zip(page.tolist(), begin[page].tolist(), spans)):
        if p not in held:
            held[p] = stored[bounds[p] : bounds[p + 1]] if known[p] else None
            if held[p] is not None:
                held[p] += links.get(p, [])
        ranges = held[p]
        if ranges is None:
            continue
        s, e = s - origin, e - origin
        for lo, hi in ranges:
            if (hi is None or s < hi) and (lo is None or e > lo):
                break
        else:
            kept.append(i)
    found, page = found[kept], page[kept]
    start, end = found[:, 0] - begin[page], found[:, 1] - begin[page]
    rows = pa.array(page + at)
    token, around = [], []
    for p, s, e in zip(page.tolist(), start.tolist(), end.tolist()):
        text = texts[p]
        token.append(text[s:e])
        around.append(text[max(s - MARGIN, 0) : e + MARGIN])
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(rows), batch.column(1).take(rows), names.take(pa.array(found[:, 2])),
            pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(token, pa.string()),
            pa.array(around, pa.string()),
        ],
        names=["job_id", "page_number", "rule_id", "offset", "length", "token", "around"],
    )
