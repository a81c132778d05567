"""Removal of long repeated substrings by suffix intervals.

All ``LENGTH``-byte strings that occur more than once are found without comparing texts pairwise:

1. Every window of LENGTH bytes is named by its k-byte string with the smallest hash, the leftmost
   one of several; that depends on the window's bytes alone, so equal windows have equal names.
   Windows that are named at the same place form a run; a run travels as a few numbers, and equal
   windows are always in different runs. Names that occur once are dropped.
2. Runs of equal bytes are one class with a weight, so copies are not multiplied. Classes of one
   name that differ need comparing: their bytes go to the bin of the name.
3. A bin sorts the suffixes of its runs to more than LENGTH bytes, forms the Burrows-Wheeler
   transform and expands intervals breadth-first: from the empty string on, intervals are extended
   backwards by one byte per step, and a boundary between neighbouring suffixes gets the step at
   which it first appears as their common prefix. The expansion stops at LENGTH: boundaries without
   a value join suffixes with LENGTH bytes in common. A group of weight two or more is repeated.

A bin is worked off in portions of whole names with about ``SORT_BYTES`` each, so that the arrays of
a portion stay small however large the bin is. A name with more than ``HOT`` differing classes or
``HOT_BYTES`` of them (a passage in very many documents) is not taken into a bin: its runs are named
anew with longer k-byte strings, at last by the whole window, where every name has a single class.

Equality of windows of one name is decided on bytes; names and equal runs are told by 64-bit
hashes.

Defined results: null text counts as empty; texts shorter than LENGTH hold no window and
lose nothing. Matches never cross documents. Repeated rows are copies of each other: each is
removed where the other covers it. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.llm import text as T
from naskah.session import materialize

LENGTH = 400
NAMES = (160, 320, 384, 400)  # k by level
HOT = 4000
HOT_BYTES = 2 << 20
BIN_BYTES = 3 << 20
SORT_BYTES = 1 << 20
BROADCAST_ROWS = 1_000_000
SEPARATOR = 0xFF  # not a byte of UTF-8
_U64 = np.uint64


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = h, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(b: T.Block, k: int) -> tuple[np.ndarray, ...]:
    """(row, name, hull, start, n) of the runs of windows in a block; hull hashes all bytes of a run."""
    total = len(b.data)
    sizes = np.maximum(b.ends - b.starts - LENGTH + 1, 0)
    if total < LENGTH or not sizes.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    p = T.prefix_hash(T.BYTE_VALUES[b.data])
    inverse = T.powers(T.BASE_INVERSE, total + 1)
    h = T.mix((p[k:] - p[:-k]) * inverse[: total - k + 1])
    place = h >> _U64(32) << _U64(32) | np.arange(len(h), dtype=_U64)
    place = _window_min(place, LENGTH - k + 1) & _U64(0xFFFFFFFF)
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(begin[-1]) - begin[row] + b.starts[row]
    place = place[at]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    length = np.diff(np.append(first, len(at)))
    name = h[place[first].astype(np.int64)]
    start = at[first]
    end = start + length - 1 + LENGTH
    hull = T.mix((p[end] - p[start]) * inverse[start] + length.astype(_U64) * T.LANES[60])
    r = row[first]
    return r, name.view(np.int64), hull.view(np.int64), start - b.starts[r], length


def _name_runs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_numpy(zero_copy_only=False)
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            for b in T.blocks(batch.column(2)):
                row, name, hull, start, n = runs(b, k)
                item, weight = items[b.rows], weights[b.rows]
                u, where, back = np.unique(item, return_index=True, return_inverse=True)
                if len(u) < len(item):  # equal items of a block travel once
                    weight = np.bincount(back, weight, len(u)).astype(np.int64)[back]
                    keep = np.zeros(len(item), bool)
                    keep[where] = True
                    row, name, hull, start, n = (x[keep[row]] for x in (row, name, hull, start, n))
                columns = (item[row], weight[row], name, hull, start, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(c, np.int64)) for c in columns], names=["item", "weight", "name", "hull", "start", "n"]
                )

    return run


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` bytes: eight bytes, then prefix doubling."""
    n = len(s)
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    key = np.zeros(n, _U64)
    for j in range(8):
        key = key << _U64(8) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.zeros(n + depth + 8, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    have = 8
    open_ = ~(new & np.append(new[1:], True))
    slots = np.flatnonzero(open_)
    while have < depth and len(slots):
        sub = order[slots]
        key = rank[sub] << 32 | rank[sub + have]
        by = np.argsort(key, kind="stable")
        sub, key = sub[by], key[by]
        order[slots] = sub
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sub] = slots[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))] + 1
        slots = slots[~(new & np.append(new[1:], True))]
        have *= 2
    return order


def joined_boundaries(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each neighbouring pair of ordered suffixes: do they share ``length`` bytes?

    Breadth-first backward extension: step l holds intervals of strings of l bytes, disjoint and
    each with a right boundary that first appeared at step l. Bytes before an interval are read
    from the runs of the transform.
    """
    n = len(s)
    bwt = s[order - 1]
    by = np.argsort(bwt, kind="stable")
    last_first = np.empty(n, np.int64)
    last_first[by] = np.arange(n)
    run_new = np.concatenate([[True], bwt[1:] != bwt[:-1]])
    run_of = np.cumsum(run_new) - 1
    run_start = np.flatnonzero(run_new)
    run_end = np.append(run_start[1:], n) - 1
    run_byte = bwt[run_start].astype(np.int64)
    joined = np.ones(n + 1, bool)  # joined[i]: suffixes i - 1 and i
    joined[[0, n]] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(length):
        if not len(lo):
            break
        first, count = run_of[lo], run_of[hi] - run_of[lo] + 1
        interval = np.repeat(np.arange(len(lo)), count)
        r = np.arange(len(interval)) - np.repeat(np.cumsum(count) - count, count) + first[interval]
        key = interval << 8 | run_byte[r]
        by = np.argsort(key, kind="stable")
        key, r, interval = key[by], r[by], interval[by]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tail = np.append(head[1:], len(key)) - 1
        inner = run_byte[r[head]] != SEPARATOR
        head, tail = head[inner], tail[inner]
        low = last_first[np.maximum(run_start[r[head]], lo[interval[head]])]
        high = last_first[np.minimum(run_end[r[tail]], hi[interval[tail]])]
        fresh = joined[high + 1] | joined[low]
        lo, hi = low[fresh], high[fresh]
        joined[hi + 1] = False
        joined[lo] = False
    return joined


def repeated_starts(texts: list[bytes], weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Starts in each text of ``length``-byte strings whose occurrences weigh two or more."""
    sizes = np.array([len(t) for t in texts])
    s = np.frombuffer(b"".join(t + bytes([SEPARATOR]) for t in texts), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    order = suffix_order(s, length)
    joined = joined_boundaries(s, order, length)
    group = np.cumsum(~joined[:-1]) - 1
    at = order - begin[owner[order]]
    whole = at + length <= sizes[owner[order]]
    weight = np.bincount(group[whole], weights[owner[order[whole]]], group[-1] + 1)
    hit = np.zeros(len(s), bool)
    hit[order[whole & (weight[group] >= 2)]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin, sizes)]


def _ranges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers."""
    if not len(x):
        return x, x
    cut = np.flatnonzero(np.diff(x) > 1)
    return x[np.append(0, cut + 1)], x[np.append(cut, len(x) - 1)]


def _portions(name: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Row numbers in portions of whole names with ``SORT_BYTES`` at most, or of one larger name."""
    order = np.argsort(name, kind="stable")
    first = np.flatnonzero(np.diff(name[order], prepend=name[order[:1]] - 1))
    held = np.add.reduceat(sizes[order], first)
    cuts, total = [], 0
    for at, n in zip(first.tolist(), held.tolist()):
        if total and total + n > SORT_BYTES:
            cuts.append(at)
            total = 0
        total += n
    return np.split(order, cuts)


def _bin(group: pa.Table) -> pa.Table:
    texts, weights = group.column("text").combine_chunks(), group.column("weight").to_numpy()
    name, hull = group.column("name").to_numpy(), group.column("hull").to_numpy()
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    out: tuple[list, ...] = ([], [], [], [])
    for rows in _portions(name, sizes):
        found = repeated_starts([texts[i].as_py() for i in rows.tolist()], weights[rows])
        for i, starts in zip(rows.tolist(), found):
            lo, hi = _ranges(starts)
            for column, values in zip(out, (np.full(len(lo), name[i]), np.full(len(lo), hull[i]), lo, hi)):
                column.append(values)
    return pa.table({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in zip(("name", "hull", "lo", "hi"), out)})


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, list of wanted runs) to rows of one run's bytes."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1)):
            data = text.as_py()
            w = wanted.values.flatten()
            name, hull, weight, start, n = (c.to_numpy() for c in w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(hull), pa.array(weight),
                 pa.array([data[a : a + m - 1 + LENGTH] for a, m in zip(start.tolist(), n.tolist())], pa.binary())],
                names=["name", "hull", "weight", "text"],
            )


def _repeated(items: DataFrame, level: int) -> DataFrame:
    """(item, lo, hi): first and last starts of repeated windows, for rows (item, weight, text)."""
    k, last = NAMES[level], level == len(NAMES) - 1
    named = materialize(
        items.mapInArrow(_name_runs(k), "item long, weight long, name long, hull long, start long, n long"),
        "runs",
    )
    names = named.groupBy("name").agg(F.sum("weight").alias("total"), F.min("hull").alias("h0"), F.max("hull").alias("h1"))
    # written first, so that the join with it can split a name of very many runs
    names = materialize(names.where("total > 1").select("name", (F.col("h0") == F.col("h1")).alias("single")), "run-names")
    kept = materialize(named.join(names, "name"), "repeated-runs")
    whole = kept.where("single").select("item", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"))
    if last:
        return whole
    rest = kept.where("NOT single")
    classes = materialize(
        rest.groupBy("name", "hull").agg(F.sum("weight").alias("weight"), F.min(F.struct("item", "start", "n")).alias("at")), "run-classes"
    )
    wanted = classes.groupBy(F.col("at.item").alias("item")).agg(
        F.collect_list(F.struct("name", "hull", "weight", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("wanted")
    )  # as many as one text holds
    wanted = materialize(wanted, "wanted-runs")
    ids = wanted.select("item")
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
    texts = items.select("item", "text").join(ids, "item", "left_semi").dropDuplicates(["item"])
    pieces = materialize(
        texts.join(wanted, "item").select("text", "wanted").mapInArrow(_cut_texts, "name long, hull long, weight long, text binary"),
        "run-bytes",
    )
    sizes = pieces.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    crowded = sizes.where((F.col("n") > HOT) | (F.col("bytes") > HOT_BYTES)).select("name")
    crowded = materialize(crowded, "crowded-names")
    some = not crowded.isEmpty()
    cold = pieces.join(crowded, "name", "left_anti") if some else pieces
    bins = max(1, (pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BIN_BYTES)
    found = (
        cold.withColumn("bin", F.pmod(F.xxhash64("name"), F.lit(bins))).groupBy("bin")
        .applyInArrow(_bin, "name long, hull long, lo long, hi long")
    )
    if some:
        hot = pieces.join(crowded, "name", "left_semi")
        key = F.xxhash64("name", "hull")
        deeper = _repeated(hot.select(key.alias("item"), "weight", "text"), level + 1)
        found = found.unionAll(hot.select("name", "hull", key.alias("item")).join(deeper, "item").select("name", "hull", "lo", "hi"))
    found = materialize(found, "repeated-windows")
    placed = rest.join(found, ["name", "hull"]).select("item", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return whole.unionAll(placed)


def _result(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, str]:
    """(bytes, removed, spans, digest) of one text, given the ranges of repeated starts."""
    if not len(lo):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest()
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    cut = np.flatnonzero(start[1:] > end[:-1])
    start, end = start[np.append(0, cut + 1)], end[np.append(cut, len(end) - 1)]
    digest, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), end.tolist()):
        digest.update(data[at:a])
        at = b
    digest.update(data[at:])
    return len(data), int((end - start).sum()), len(start), digest.hexdigest()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and the removed ranges (array of lo, hi) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("item", F.xxhash64("text"))
    long = rows.where(F.octet_length("text") >= LENGTH)
    ranges = _repeated(long.select("item", F.lit(1).cast("long").alias("weight"), "text"), 0)
    per = materialize(ranges.groupBy("item").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")  # as many as one text holds
    few = per.count() <= BROADCAST_ROWS
    touched = F.broadcast(per.select("item")) if few else per.select("item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column(1), batch.column(2)):
                lo, hi = (c.to_numpy() for c in spans.values.flatten()) if spans.is_valid else (np.zeros(0, np.int64),) * 2
                out.append(_result(data.as_py(), lo, hi))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    # texts without a repeat are not shuffled
    clean = rows.join(touched, "item", "left_anti").withColumn("ranges", F.lit(None).cast(per.schema["ranges"].dataType))
    cut = rows.join(touched, "item", "left_semi").join(per, "item")
    both = clean.select("id", "text", "ranges").unionAll(cut.select("id", "text", "ranges"))
    return both.mapInArrow(run, schema).withColumnRenamed("id", key)
