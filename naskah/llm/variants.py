"""Spelling variants by a trie over letter-group counts.

Letters fall into ``GROUPS`` groups; a word's vector holds how many of its letters are in each. One
edit changes the vector by at most one surplus and one deficit: an insertion adds one to a group, a
deletion takes one, a replacement does both or, within a group, neither. The trie arranges words by
successive counts. A depth-first search carries words down with a budget of one surplus and one
deficit; at a leaf the words of equal vector are verified letter by letter. Every unordered pair is
found from one side only: from the shorter word, or from the word that spends its surplus on the
earlier group, so a deficit may only follow a surplus.

The trie is spread over the cluster by its own top: prefixes with more than ``UNIT`` words are
internal, everything below the first other prefix is one subtree and one group. The internal
prefixes (at most ``GROUPS`` * words / ``UNIT``, so a few bytes per thousand words) are known to all
tasks, which walk words through them by the same rule and send them to the subtrees they reach. A
single vector with more than ``UNIT`` words is split once more, by the halves of its words: one edit
leaves one half as it is.

Defined results: null or empty text has no words; a null key counts as the empty string; repeated
rows count again; the hash and case rules follow the contract of the query; other columns are
ignored; an empty table gives no rows. Runs are taken whole, however long.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.session import materialize

GROUPS = 10
UNIT = 20_000
MIN_LETTERS = 5
MIN_COUNT = 3
FACTOR = 2
TYPO_EVERY = 97
FLUSH_WORDS = 300_000
PAIRS = 1 << 18
WIDE = 64
#: Letters from frequent to rare, dealt over the groups in turn, so that groups weigh alike.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
GROUP_OF = np.arange(256) % GROUPS
GROUP_OF[[ord(c) for c in BY_FREQUENCY]] = np.arange(len(BY_FREQUENCY)) % GROUPS
_COUNT = np.dtype(">u4")
_STEP = _COUNT.itemsize


def altered(key: str, run: str, crc: int | None = None) -> str:
    """``run``, or in one of ``TYPO_EVERY`` cases, chosen by a hash of key and run, without one letter."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{key}:".encode()) if crc is None else crc)
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of all words with ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                crc = zlib.crc32(f"{name.as_py() or ''}:".encode())
                lowered = value.as_buffer().to_pybytes().translate(LOWER).decode()
                for run, n in Counter(RUN.findall(lowered)).items():
                    if len(run) >= MIN_LETTERS and len(word := altered("", run, crc)) >= MIN_LETTERS:
                        total[word] += n
                if len(total) > FLUSH_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    seen = docs.select(F.col(key).cast("string"), text).mapInArrow(count, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts per letter group of words in Latin-1."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.repeat(np.arange(len(words)), sizes)
    letters = np.frombuffer(b"".join(words), np.uint8)
    return np.bincount(rows * GROUPS + GROUP_OF[letters], minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _next(counts: np.ndarray, states: np.ndarray, child: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words may go down to the child with this count, and their state there.

    State 0: nothing spent; 1: surplus spent; 2: both spent.
    """
    surplus = (counts == child - 1) & (states == 0)
    deficit = (counts == child + 1) & (states == 1)
    go = np.flatnonzero((counts == child) | surplus | deficit)
    return go, states[go] + (surplus | deficit)[go]


def halves(word: bytes, length: int, own: bool) -> list[bytes]:
    """Pieces by which words of one full vector and ``length`` letters meet; one edit keeps one of a pair.

    First two pieces: for words of equal length. Last two: for words one letter shorter, which
    meet with the first and last letters of the longer one. ``own``: a word of the vector itself.
    """
    h, k = length // 2, (length - 1) // 2
    pieces = []
    if len(word) == length:
        pieces += [b"0" + word[:h], b"1" + word[h:]]
    if own or len(word) < length:
        pieces += [b"2" + word[:k], b"3" + word[k + own :]]
    return pieces


def routes(words: list[bytes], internal: frozenset[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(subtree, word numbers, states) for all subtrees that the words reach through the top of the trie."""
    counts = vectors(words)

    def walk(prefix: bytes, rows: np.ndarray, states: np.ndarray) -> Iterator:
        level = len(prefix) // _STEP
        if prefix not in internal:
            yield prefix, rows, states
        elif level < GROUPS:
            own = counts[rows, level]
            children = np.unique(own[:, None] + np.array([-1, 0, 1]))
            for child in children[children >= 0]:
                go, then = _next(own, states, child)
                if len(go):
                    yield from walk(prefix + int(child).to_bytes(_STEP, "big"), rows[go], then)
        else:
            length = int(np.frombuffer(prefix, _COUNT).sum())
            by: dict[bytes, list[int]] = {}
            for i, (row, state) in enumerate(zip(rows, states, strict=True)):
                for piece in halves(words[row], length, state == 0):
                    by.setdefault(piece, []).append(i)
            for piece, i in by.items():
                yield prefix + piece, rows[i], states[i]

    yield from walk(b"", np.arange(len(words)), np.zeros(len(words), np.int64))


def one_edit(a: bytes, b: bytes) -> bool:
    """``b`` is ``a`` with one letter replaced, or with one letter more."""
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :] and a != b


class Subtree:
    """Words of one subtree and the words sent to it; collects verified pairs."""

    def __init__(self, words: list[bytes], states: np.ndarray, prefix: bytes):
        self.words, self.states, self.prefix = words, states, prefix
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = min(int(self.sizes.max(initial=0)), WIDE) + 1
        self.letters = np.zeros((len(words), width), np.uint8)
        for i, w in enumerate(words):
            if len(w) < width:
                self.letters[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.waits = 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, word) numbers of all near pairs, each once."""
        entries = np.flatnonzero(self.states == 0)
        depth = len(self.prefix) // _STEP
        if depth > GROUPS or (depth == GROUPS and len(self.prefix) > GROUPS * _STEP):
            self.meet(entries, np.arange(len(self.words)))
        elif len(entries):
            self.counts = vectors(self.words)
            entries = entries[np.lexsort(self.counts[entries].T[::-1])]
            self.search(depth, entries, np.arange(len(self.words)), self.states)
        self.verify()
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*self.found, strict=True))
        return a, b

    def search(self, level: int, entries: np.ndarray, rows: np.ndarray, states: np.ndarray) -> None:
        """Depth first below the node of ``entries`` (sorted) with the words ``rows`` that got there."""
        if level == GROUPS:
            self.leaf(entries, rows, states)
            return
        counts, own = self.counts[entries, level], self.counts[rows, level]
        cuts = np.flatnonzero(np.diff(counts)) + 1
        for at, to in zip([0, *cuts], [*cuts, len(entries)], strict=True):
            go, then = _next(own, states, counts[at])
            if len(go):
                self.search(level + 1, entries[at:to], rows[go], then)

    def leaf(self, entries: np.ndarray, rows: np.ndarray, states: np.ndarray) -> None:
        """Candidate pairs at a leaf; a large one is searched by the halves of its words."""
        if len(entries) * len(rows) <= PAIRS:
            self.cross(entries, rows, states == 0)
            return
        length = int(self.sizes[entries[0]])
        for own in (True, False):
            by: dict[bytes, tuple[list[int], list[int]]] = {}
            for side, numbers in ((0, entries), (1, rows[(states == 0) == own])):
                for i in numbers:
                    # words of the vector meet each other by equal halves only
                    for piece in halves(self.words[i], length, side == 0)[: 2 if own else 4]:
                        by.setdefault(piece, ([], []))[side].append(i)
            for piece, (left, right) in by.items():
                self.meet(np.array(left, np.int64), np.array(right, np.int64), piece[:1], own)

    def meet(self, entries: np.ndarray, rows: np.ndarray, kind: bytes | None = None, own: bool | None = None) -> None:
        """Pairs of words with an equal half; the second half counts where the first one differs."""
        kind = kind or self.prefix[GROUPS * _STEP : GROUPS * _STEP + 1]
        if kind in b"23":  # for words one letter shorter
            rows = rows[self.states[rows] != 0] if own is None else rows
        if not len(entries) or not len(rows):
            return
        length = int(self.sizes[entries[0]])
        rows = rows[self.sizes[rows] == length - (kind in b"23")]
        cut = (length - (kind in b"23")) // 2 if kind in b"13" else None
        inside = self.states[rows] == 0 if own is None else np.full(len(rows), own)
        self.cross(entries, rows, inside, cut)

    def cross(self, entries: np.ndarray, rows: np.ndarray, inside: np.ndarray, cut: int | None = None) -> None:
        """Queues entries x rows in slices; of two words of the vector (``inside``) one order only."""
        step = max(1, PAIRS // max(len(entries), 1))
        for at in range(0, len(rows), step):
            a = np.repeat(entries, len(rows[at : at + step]))
            b = np.tile(rows[at : at + step], len(entries))
            ok = ~np.tile(inside[at : at + step], len(entries)) | (a > b)
            if cut is not None:
                first = [self.words[i][:cut] for i in entries], {i: self.words[i][:cut] for i in rows[at : at + step]}
                ok &= np.array([x != first[1][j] for x in first[0] for j in rows[at : at + step]], bool)
            self.waiting.append((a[ok], b[ok]))
            self.waits += int(ok.sum())
            if self.waits >= PAIRS:
                self.verify()

    def verify(self) -> None:
        """Keeps the queued pairs that differ by one edit; the first word is never the shorter one."""
        if not self.waiting:
            return
        a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.waits = [], 0
        gap = self.sizes[a] - self.sizes[b]
        fits = (gap == 0) | (gap == 1)
        a, b, gap = a[fits], b[fits], gap[fits]
        wide = self.sizes[a] >= self.letters.shape[1]
        good = np.zeros(len(a), bool)
        for i in np.flatnonzero(wide):
            good[i] = one_edit(self.words[b[i]], self.words[a[i]])
        slim = np.flatnonzero(~wide)
        if len(slim):
            width = int(self.sizes[a[slim]].max()) + 1
            x, y = self.letters[a[slim], :width], self.letters[b[slim], :width]
            differ = x != y
            # behind the first difference the longer word goes on one letter later
            later = (x[:, 1:] != y[:, :-1]) & (np.arange(width - 1) >= differ.argmax(axis=1)[:, None])
            good[slim] = np.where(gap[slim] == 0, differ.sum(axis=1) == 1, ~later.any(axis=1))
        self.found.append((a[good], b[good]))


def near_words(words: DataFrame, unit: int = UNIT) -> DataFrame:
    """``word, n_near, form, form_n``: near words of each of ``words`` (``word, n``) that has any, and
    the most frequent of them, ties going to the smallest in code-point order."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors(_latin(batch.column(0))).astype(_COUNT)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["v"])

    levels = F.explode(F.sequence(F.lit(0), F.lit(GROUPS)))
    nodes = words.select("word").mapInArrow(prefixes, "v binary").select("v", levels.alias("level"))
    nodes = nodes.groupBy(F.expr(f"substring(v, 1, {_STEP} * level)").alias("prefix"), "level").count()
    internal = frozenset(bytes(r["prefix"]) for r in nodes.where(F.col("count") > unit).select("prefix").collect())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix, rows, states in routes(_latin(batch.column(0)), internal):
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prefix] * len(rows), pa.binary()), part.column(0), part.column(1), pa.array(states, pa.int32())],
                    ["subtree", "word", "n", "state"],
                )

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        tree = Subtree([w.encode("latin-1") for w in words], table.column("state").to_numpy(), table.column("subtree")[0].as_py())
        a, b = tree.pairs()
        near = np.bincount(np.concatenate([a, b]), minlength=len(words))
        order = np.array(sorted(range(len(words)), key=lambda i: (-counts[i], words[i])), np.int64)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        best = np.full(len(words), len(words))
        np.minimum.at(best, a, rank[b])
        np.minimum.at(best, b, rank[a])
        have = np.flatnonzero(near)
        form = order[best[have]]
        return pa.table({
            "word": pa.array([words[i] for i in have], pa.string()), "n_near": pa.array(near[have], pa.int64()),
            "form": pa.array([words[i] for i in form], pa.string()), "form_n": pa.array(counts[form], pa.int64()),
        })

    sent = words.select("word", "n").mapInArrow(send, "subtree binary, word string, n long, state int")
    found = sent.groupBy("subtree").applyInArrow(search, "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    ).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of forms of every word of ``forms`` (``word, form``).

    A form occurs at least ``FACTOR`` times as often as its word, so a chain has no circle and as
    many links as the largest count has binary digits; each round doubles the stretch covered.
    """
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        current = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return current


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of the texts."""
    words = materialize(word_counts(docs, key, text), "words")
    near = materialize(near_words(words, unit), "near")
    joined = materialize(
        words.join(near, "word", "left").withColumn("is_variant", F.col("form_n") >= FACTOR * F.col("n")), "variants"
    )
    ends = roots(joined.where("is_variant"))
    mine = F.when(F.col("is_variant"), F.col("form")), F.when(F.col("is_variant"), F.col("form_n"))
    return joined.join(ends, "word", "left").select(
        "word", mine[0].alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), mine[1].alias("form_n"),
    )
