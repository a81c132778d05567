"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles; documents with equal sets form a class.
Two classes of sizes m <= n with Jaccard >= 0.75 share at least ceil(0.75 n) shingles. In one
common order of all shingles their prefixes of ``size - ceil(0.75 size) + l`` therefore share at
least ``l`` shingles. The order puts shingles seen in many documents last. For the rounds below, each
class picks the ``l`` with the least estimated cost: one posting more per step, against candidates,
estimated as the list lengths of the prefix divided by ``l`` (a shingle not known to be common counts
one). When pairs are formed, the sizes of both decide: a link needs ``ceil(3 (m + n) / 7)`` shingles in
common, of which as many must be in both longest prefixes as do not fit behind them. The larger class
leaves all but one of so many lists out of the search, its longest ones: one shared list is always left.
A smaller class with fewer lists in all is no partner.

Postings travel as packed blocks per bucket; a bucket keeps the shingles of more than one class.
Large groups of near copies would give all pairs of the group. Before pairs are formed, rounds of
single links contract them: every list names ``CENTRES`` classes by as many hashes; each class that is not
yet in the component of a centre is matched with it, the ``NEAR`` best matches of a class, and of a
component with a centre, are verified, and verified links merge components. Rounds end when nothing
links, or after ``ROUNDS``. Afterwards pairs are formed only between classes of different
components, which is all that components need; no pair that could still join two components is
left out, however the rounds went. One class in ``SLICE`` comes first as the larger one, so that its
links close lists before the others follow.

Verification is exact on the shingle hashes (64 bits): a parity bitmap, whose difference never
exceeds that of the sets, discards most false candidates before the sets are read.

Defined results: null or empty text, or one without words: empty set, linked with nothing. With
fewer than five words the whole sequence is the only shingle. Repeated rows and equal texts are
one class. Null keys stay as rows; they take part in components, whose id is the smallest key
that is not null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from naskah.llm import text as T
from naskah.llm.components import components
from naskah.session import materialize

PERCENT = 75
SHINGLE = 5
LONGEST = 16  # largest l
LARGEST = (1 << 24) - 1  # sizes in postings stop here; such sets pass the size filter together
HOT_SHINGLES = 1 << 16  # shingles with a place in the order; all others come before them, by hash
BITS = 1024
BUCKET_POSTINGS = 250_000
BROADCAST_ROWS = 1_000_000
ROUNDS = 3
SLICE = 8
CENTRES = 4
NEAR = 4
_U64 = np.uint64


def doc_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for b in T.blocks(texts):
        h, first = T.shingles(T.words(b), SHINGLE)
        for s, e in zip(first[:-1], first[1:]):
            x = np.sort(h[s:e])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            yield x


def _need(n: np.ndarray | int) -> np.ndarray | int:
    return -(-PERCENT * n // 100)


def _signature(x: np.ndarray) -> int:
    return int(T.mix(np.array([T.mix(x * T.LANES[40]).sum(dtype=_U64) + _U64(len(x))]))[0].view(np.int64))


def _bitmap(x: np.ndarray) -> np.ndarray:
    parity = np.bincount((x & _U64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of kind 0 per document (id, n, sig, bits) and of kind 1 for shingles that repeat (sig, n).

    Kind 1 counts documents within stretches of some thousand; a shingle's counts add up to an
    estimate that never exceeds its document count. They steer the order only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, held = [], 0

        def common() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(stretch), return_counts=True)
            keep = n >= 4
            u, n = u[keep].view(np.int64), n[keep]
            none = pa.nulls(len(u))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(u), np.int32)), none.cast(kind), pa.array(n), pa.array(u), none.cast(pa.list_(pa.int64()))],
                names=["kind", "id", "n", "sig", "bits"],
            )

        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, sigs, bits = [], [], []
                for x in doc_sets(part.column(1)):
                    sizes.append(len(x))
                    sigs.append(_signature(x) if len(x) else None)
                    bits.append(_bitmap(x) if len(x) else None)
                    stretch.append(x)
                    held += len(x)
                    if held > 1_000_000:
                        yield common()
                        stretch, held = [], 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sizes), np.int32)), part.column(0), pa.array(sizes, pa.int64()),
                     pa.array(sigs, pa.int64()), pa.array(bits, pa.list_(pa.int64()))],
                    names=["kind", "id", "n", "sig", "bits"],
                )
        if held:
            yield common()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"kind int, id {kind}, n long, sig long, bits array<long>")


def prefix(x: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(shingles, level, l, is hot): the prefix of length LONGEST and the smallest l that reaches each shingle."""
    n = len(x)
    base = n - _need(n) + 1
    length = min(n, base + LONGEST - 1)
    freq = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
        freq = np.where(hot[at] == x, hot_counts[at], 0)
    order = np.argsort(freq, kind="stable")[:length] if freq.any() else np.arange(length)
    lists = np.cumsum(np.maximum(freq[order], 1))
    steps = np.arange(1, min(LONGEST, _need(_need(n))) + 1)  # any partner has _need(n) shingles at least
    cost = 2 * (steps - 1) + lists[np.minimum(length, base + steps - 1) - 1] / steps
    best = int(steps[cost.argmin()])
    level = np.maximum(np.arange(length) - base + 2, 1)
    return x[order], level, best, freq[order] > 0


def _postings(docs: DataFrame, text: str, hot: np.ndarray, hot_counts: np.ndarray, buckets: int) -> DataFrame:
    """Packed prefix postings per bucket, equal sets of a stretch once."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, hot_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_counts = shared.value
        parts: list[tuple] = []
        seen: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            token, sig, info, is_hot = (np.concatenate([p[i] for p in parts]) for i in range(4))
            bucket = np.where(is_hot, -1 - (sig.view(_U64) % _U64(buckets)).astype(np.int64), (token % _U64(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            keys, at = np.unique(bucket[order], return_index=True)
            cuts = np.append(at, len(order))
            columns = [[a[order[s:e]].tobytes() for s, e in zip(cuts[:-1], cuts[1:])] for a in (token, sig, info)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "token", "sig", "info"]
            )

        for batch in batches:
            for x in doc_sets(batch.column(0)):
                if not len(x):
                    continue
                sig = _signature(x)
                if sig in seen:
                    continue
                seen.add(sig)
                tokens, level, best, is_hot = prefix(x, hot, hot_counts)
                info = (min(len(x), LARGEST) << 8 | (best - 1) << 4 | level - 1).astype(np.uint32)
                parts.append((tokens, np.full(len(tokens), sig, np.int64), info, is_hot))
                held += len(tokens)
                if held > 250_000:
                    yield flush()
                    parts, seen, held = [], set(), 0
        if parts:
            yield flush()

    return docs.select(text).mapInArrow(run, "bucket long, token binary, sig binary, info binary")


_POSTING = "token long, sig long, n int, best int, level int"


def _shared(key: tuple, group: pa.Table) -> pa.Table:
    """Postings of one bucket whose shingle is in more than one class; those of hot shingles all."""
    token, sig, info = (
        np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in group.column(c)])
        for c, kind in (("token", _U64), ("sig", np.int64), ("info", np.uint32))
    )
    order = np.lexsort((sig, token))
    token, sig, info = token[order], sig[order], info[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    token, sig, info = token[new], sig[new], info[new].astype(np.int64)
    if key[0].as_py() >= 0:
        same = token[1:] == token[:-1]
        many = np.zeros(len(token), bool)
        many[1:] |= same
        many[:-1] |= same
        token, sig, info = token[many], sig[many], info[many]
    return pa.table({
        "token": token.view(np.int64), "sig": sig, "n": (info >> 8).astype(np.int32),
        "best": (info >> 4 & 15).astype(np.int32) + 1, "level": (info & 15).astype(np.int32) + 1,
    })


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _verify(pairs: DataFrame, classes: DataFrame, sets: list[DataFrame], docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b) with Jaccard at or above the threshold, as written edges; ``sets`` grows by what was read."""
    spark = docs.sparkSession
    side = classes.select("sig", "n", "bits", "id")
    both = (
        pairs.join(side.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("id").alias("ia")), "a")
        .join(side.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("id").alias("ib")), "b")
    )
    total = F.col("na") + F.col("nb")
    least = F.ceil(PERCENT * total / (100 + PERCENT))
    differ = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = materialize(both.where(differ <= total - 2 * least).select("a", "b", "ia", "ib", least.alias("least")), "pairs")
    wanted = likely.select(F.col("a").alias("sig"), F.col("ia").alias("id")).unionAll(likely.select("b", "ib")).distinct()
    if sets:
        wanted = wanted.join(_together(sets).select("sig"), "sig", "left_anti")
    wanted = materialize(wanted, "wanted")
    n = wanted.count()
    if n:
        ids = wanted.select(F.col("id").alias("_id")).distinct()
        ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
        rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        rows = rows.join(ids, F.col("_key").eqNullSafe(F.col("_id")), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [x for x in doc_sets(batch.column(0)) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_signature(x) for x in got], pa.int64()), pa.array([x.view(np.int64) for x in got], pa.list_(pa.int64()))],
                    names=["sig", "shingles"],
                )

        read = rows.select("_text").mapInArrow(run, "sig long, shingles array<long>").dropDuplicates(["sig"])
        sets.append(materialize(read, "sets"))
    if not sets:
        return spark.createDataFrame([], "u long, v long")
    every = _together(sets)
    checked = (
        likely.join(every.select(F.col("sig").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(every.select(F.col("sig").alias("b"), F.col("shingles").alias("sb")), "b")
        .where(F.size(F.array_intersect("sa", "sb")) >= F.col("least"))
    )
    return materialize(checked.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    return postings.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "component", F.coalesce("component", "sig")
    )


def _open_lists(postings: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """Postings of lists that still hold more than one component."""
    rows = _labelled(postings, labels)
    lists = rows.groupBy(*group).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return rows.join(lists.select(*group), group, "left_semi")


def _merge(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after components were hooked to the smallest one they are linked with.

    Chains are followed four links far; what stays apart is merged by a later round or at the end.
    """
    ends = found
    for side in ("u", "v"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
        ends = ends.withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    ends = ends.select(F.greatest("cu", "cv").alias("c"), F.least("cu", "cv").alias("to")).where("c <> to")
    hook = ends.groupBy("c").agg(F.min("to").alias("to"))
    for _ in range(2):
        after = hook.select(F.col("c").alias("to"), F.col("to").alias("next"))
        hook = hook.join(after, "to", "left").select("c", F.coalesce("next", "to").alias("to"))
    new = found.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels, "node", "left")
    every = labels.join(new.select("node"), "node", "left_anti").unionAll(
        new.select("node", F.coalesce("component", "node").alias("component"))
    )
    return every.join(hook, every.component == hook.c, "left").select("node", F.coalesce("to", "component").alias("component"))


def _nearest_centres(lists: DataFrame, turn: int) -> DataFrame:
    """(a, b): classes of open lists with centres of other components, at most ``NEAR`` of each class
    and of each component with one centre, those with most shared lists first."""
    ranked = [F.struct(F.xxhash64("sig", F.lit(turn * CENTRES + i)).alias("rank"), "sig", "component") for i in range(CENTRES)]
    centres = lists.groupBy("token", "k").agg(F.array(*[F.min(r) for r in ranked]).alias("cs")).select(
        "token", "k",
        F.explode(F.array_distinct(F.transform("cs", lambda c: F.struct(c["sig"].alias("sig"), c["component"].alias("component"))))).alias("c"),
    )
    near = (
        lists.join(centres, ["token", "k"]).where("component <> c.component")
        .groupBy("sig", "component", F.col("c.sig").alias("centre"), "best").count().where("count >= best")
    )
    for keys in (["sig"], ["component", "centre"]):
        most = Window.partitionBy(*keys).orderBy(F.desc("count"), F.xxhash64("sig", "centre"))
        near = near.withColumn("place", F.row_number().over(most)).where(F.col("place") <= NEAR)
    return near.select(F.col("sig").alias("a"), F.col("centre").alias("b"))


def _sized(n: Column) -> Column:
    """Size class: sets that can be linked are in equal or neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")


def _in_prefixes(na: Column, nb: Column) -> Column:
    """How many shingles that both longest prefixes hold a link of sizes ``na`` >= ``nb`` needs.

    Behind the longer prefix lie ``ceil(0.75 na) - LONGEST`` shingles, behind the other no more.
    """
    behind = F.greatest(F.ceil(PERCENT * na / 100) - LONGEST, F.lit(0))
    return F.ceil(PERCENT * (na + nb) / (100 + PERCENT)) - behind


def _pairs(postings: DataFrame, larger: Column) -> DataFrame:
    """(a, b): pairs of open lists that can be linked, the larger class chosen by ``larger``."""
    lengths = postings.groupBy("token").agg(F.count("*").alias("length"))
    own = Window.partitionBy("sig")  # one class: at most its prefix
    ranked = materialize(
        postings.join(lengths, "token").select(
            "token", "sig", F.col("n").cast("long").alias("n"), "component", _sized(F.col("n")).alias("k"),
            F.row_number().over(own.orderBy(F.desc("length"), "token")).alias("place"), F.count("*").over(own).alias("lists"),
        ),
        "ranked",
    )
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")
    # what the smallest partner asks of the larger class, and the equal or the largest one of the smaller; one less for rounding
    capped = n == LARGEST
    as_larger = _in_prefixes(n, F.ceil(PERCENT * n / 100))
    as_smaller = F.least(_in_prefixes(n, n), _in_prefixes(F.floor(100 * n / PERCENT), n) - 1)
    left = ranked.where(larger & (capped | (F.col("place") >= as_larger))).select(
        "token", F.col("sig").alias("a"), n.alias("na"), F.col("component").alias("ca"), "place", "k"
    )
    right = ranked.where(capped | (100 * n >= PERCENT * LARGEST) | (F.col("lists") >= as_smaller)).select(
        "token", F.col("sig").alias("b"), n.alias("nb"), F.col("component").alias("cb"), "lists",
        F.explode(F.array("k", F.col("k") + 1)).alias("k"),
    )
    # sizes in ascending order (b before a), so that each pair of a list comes once
    ordered = (nb < na) | ((nb == na) & (F.col("b") < F.col("a")))
    enough = F.least("place", "lists") >= _in_prefixes(na, nb)
    return (
        left.join(right, ["token", "k"])
        .where(ordered & (F.col("ca") != F.col("cb")) & (100 * nb >= PERCENT * na) & ((na == LARGEST) | enough))
        .select("a", "b").distinct()
    )


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, class_id, component_id of every row of ``docs``.

    ``class_id`` is the smallest key with an equal set, ``component_id`` the smallest key reachable
    over links.
    """
    spark = docs.sparkSession
    described = materialize(describe(docs, key, text), "shingle-sets")
    members = described.where("kind = 0").select("id", "n", "sig")
    classes = materialize(
        described.where("kind = 0 AND sig IS NOT NULL").groupBy("sig", "n").agg(F.min("id").alias("id"), F.first("bits").alias("bits")),
        "classes",
    )
    # at most HOT_SHINGLES rows reach the driver; they steer the order, not the result
    common = described.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sig").limit(HOT_SHINGLES)
    table = common.toArrow()
    hot = table.column("sig").to_numpy().astype(np.int64).view(_U64)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], table.column("n").to_numpy().astype(np.int64)[order]
    total = classes.agg(F.sum(F.col("n") * (100 - PERCENT) / 100 + LONGEST)).first()[0] or 0
    buckets = max(16, int(total // BUCKET_POSTINGS))
    packed = _postings(docs, text, hot, hot_counts, buckets)
    postings = materialize(packed.groupBy("bucket").applyInArrow(_shared, _POSTING), "postings")

    sets: list[DataFrame] = []
    links: list[DataFrame] = []
    labels = spark.createDataFrame([], "node long, component long")
    lists = postings.where("level = 1").select("token", "sig", "best", _sized(F.col("n")).alias("k"))
    for turn in range(ROUNDS):
        open_rows = materialize(_open_lists(lists, labels, ["token", "k"]).select("token", "k", "sig", "best", "component"), "lists")
        lists = open_rows.drop("component")  # components only grow, so a list of a single one stays so
        near = _nearest_centres(open_rows, turn)
        found = _verify(near, classes, sets, docs, key, text)
        if found.isEmpty():
            break
        links.append(found)
        labels = materialize(_merge(labels, found), "labels")

    first = F.pmod(F.xxhash64("sig"), F.lit(SLICE)) == 0
    for larger in (first, ~first):
        postings = materialize(_open_lists(postings, labels, ["token"]), "open-postings")
        found = _verify(_pairs(postings, larger), classes, sets, docs, key, text)
        links.append(found)
        postings = postings.drop("component")
        labels = materialize(_merge(labels, found), "labels")
    labels = materialize(components(_together(links)), "labels")

    named = classes.select("sig", "n", "id").join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    named = named.withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("sig", F.col("id").alias("class_id"), "component_id")
    return members.join(named, "sig", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"),
    )
