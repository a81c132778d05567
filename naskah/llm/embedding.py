"""Near-duplicate vectors by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and a fast Hadamard transform and takes the
index and sign of its largest coordinate; ``K`` of them make the key of a table. A vector is stored
under its own key and looked up under the ``PROBES`` keys that its next largest coordinates make
likely, in each of ``TABLES`` tables. For a pair at the threshold a table finds it with a chance
above 0.9, so that all tables miss it with a chance near 1e-8. Every candidate pair is verified by
cosine in double precision.

Equal vectors are one class with a multiplicity. Buckets are worked off as units of at most
``2 * UNIT`` vectors: a larger bucket is cut into parts, and each pair of parts is one unit, so no
bucket is capped and no pair rows are written. A pair that meets several times counts where it
meets first, which a unit can tell from the two vectors alone. Units return link counts and the
links that keep their components connected.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and
vectors without a label, link with nothing: n_links 0, their own component, kept. Only equal
labels and equal lengths are compared. Repeated rows are separate vectors. Other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.llm.components import components
from naskah.llm.text import mix
from naskah.session import materialize

COSINE = 0.98
TABLES = 8
PROBES = 8
UNIT = 2000
BIN_ROWS = 20_000
SEED = 11
_U64 = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def table_keys(x: np.ndarray, k: int) -> np.ndarray:
    """n x TABLES x PROBES keys of unit vectors; the first of each table is the vector's own."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - dim)))
    rng = np.random.default_rng(SEED)
    top = min(3, width)
    choices = np.stack(np.meshgrid(*[np.arange(top)] * k, indexing="ij"), -1).reshape(-1, k)
    choices = choices[(choices > 0).sum(1) <= 2]
    keys = np.zeros((n, TABLES, PROBES), _U64)
    for t in range(TABLES):
        cost, code = np.zeros((n, len(choices))), np.full((n, len(choices)), t + 1, _U64)
        for j in range(k):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            at = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :top]
            value = np.take_along_axis(y, at, 1)
            name, size = (2 * at + (value < 0)).astype(_U64), np.abs(value)
            pick = choices[:, j]
            cost += (size[:, :1] - size[:, pick]) ** 2
            code = code * _U64(2 * width + 1) + name[:, pick]
        order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        got = np.take_along_axis(code, order, 1)
        keys[:, t, : got.shape[1]] = got
        keys[:, t, got.shape[1] :] = got[:, :1]
    return keys


def _unit_vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _hash(k: int):
    def run(batches):
        for batch in batches:
            ids, groups, vectors = batch.columns
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                at = pa.array(rows)
                keys = table_keys(_unit_vectors(vectors.take(at)), k)
                salt = mix(groups.take(at).to_numpy(zero_copy_only=False).astype(np.int64).view(_U64))
                n = TABLES * PROBES
                flat = mix(keys + salt[:, None, None]).reshape(len(rows), n)
                own = np.zeros((TABLES, PROBES), bool)
                own[:, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids.take(at).to_numpy(zero_copy_only=False), n)), pa.array(flat.reshape(-1).view(np.int64)),
                     pa.array(np.tile(own.reshape(-1), len(rows)).astype(np.int32))],
                    names=["cls", "bucket", "own"],
                )

    return run


def _pairs(unit: np.ndarray, x: np.ndarray):
    """(a, b) row pairs of equal unit with a cosine at or above the threshold, unit by unit."""
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(np.append(starts, len(unit)))
    small = np.repeat(sizes <= 32, sizes)
    step = 1
    while True:
        a = np.arange(len(unit) - step)
        a = a[small[a] & (unit[a] == unit[a + step])]
        if not len(a):
            break
        good = np.einsum("ij,ij->i", x[a], x[a + step]) >= COSINE
        yield a[good], a[good] + step
        step += 1
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
        for lo in range(0, n, 512):
            c = x[s + lo : s + min(n, lo + 512)] @ x[s : s + n].T
            a, b = np.nonzero(c >= COSINE)
            keep = b > a + lo
            yield a[keep] + s + lo, b[keep] + s


def _work(k: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("unit", "ascending"), ("cls", "ascending")])
        column = {c: group.column(c).to_numpy() for c in ("unit", "bucket", "cls", "own", "grp", "part", "lo", "hi", "copies")}
        x = _unit_vectors(group.column("vector"))
        _, at, row_class = np.unique(column["cls"], return_index=True, return_inverse=True)
        keys, counts, label = None, np.zeros(len(at), np.int64), np.arange(len(at))
        edges_u, edges_v = [], []
        salt = mix(column["grp"].astype(np.int64).view(_U64))[at]
        for a, b in _pairs(column["unit"], x):
            own = (column["own"][a] | column["own"][b]).astype(bool) & (column["cls"][a] != column["cls"][b])
            parts = np.sort(np.stack([column["part"][a], column["part"][b]]), axis=0)
            own &= (parts[0] == column["lo"][a]) & (parts[1] == column["hi"][a]) & (column["grp"][a] == column["grp"][b])
            a, b = a[own], b[own]
            if not len(a):
                continue
            if keys is None:
                keys = mix(table_keys(x[at], k) + salt[:, None, None])
            ca, cb = row_class[a], row_class[b]
            swap = column["cls"][a] > column["cls"][b]
            ca, cb = np.where(swap, cb, ca), np.where(swap, ca, cb)
            here = column["bucket"][a].view(_U64)
            # meetings in order: per table the bucket of the smaller class, then that of the other
            first = np.zeros(len(a), _U64)
            open_ = np.ones(len(a), bool)
            for t in range(TABLES):
                for owner, seeker in ((ca, cb), (cb, ca)):
                    bucket = keys[owner, t, 0]
                    met = open_ & (keys[seeker, t] == bucket[:, None]).any(1)
                    first[met] = bucket[met]
                    open_ &= ~met
            mine = first == here
            ca, cb = ca[mine], cb[mine]
            # the same bucket can hold a pair as two rows: own and probed
            pair = np.unique(np.stack([ca, cb], 1), axis=0)
            ca, cb = pair[:, 0], pair[:, 1]
            np.add.at(counts, ca, column["copies"][at][cb])
            np.add.at(counts, cb, column["copies"][at][ca])
            while True:  # spanning links: merge labels, keep the links that merged
                u, v = label[ca], label[cb]
                apart = u != v
                if not apart.any():
                    break
                lo, hi = np.minimum(u, v)[apart], np.maximum(u, v)[apart]
                hi, pick = np.unique(hi, return_index=True)
                edges_u.append(column["cls"][at][ca[apart][pick]])
                edges_v.append(column["cls"][at][cb[apart][pick]])
                target = np.arange(len(label))
                target[hi] = lo[pick]
                while (target[target] != target).any():
                    target = target[target]
                label = target[label]
        used = np.flatnonzero(counts)
        u = np.concatenate([*edges_u, np.zeros(0, np.int64)])
        v = np.concatenate([*edges_v, np.zeros(0, np.int64)])
        none = pa.nulls(len(used), pa.int64())
        return pa.table({
            "cls": pa.concat_arrays([pa.array(column["cls"][at][used]), pa.nulls(len(u), pa.int64())]),
            "links": pa.concat_arrays([pa.array(counts[used]), pa.nulls(len(u), pa.int64())]),
            "u": pa.concat_arrays([none, pa.array(u)]), "v": pa.concat_arrays([none, pa.array(v)]),
        })

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    usable = v.isNotNull() & F.col("lab").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(nonzero, F.lit(False))
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("lab"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("grp", F.when(usable, F.xxhash64("lab", F.size("vector"))))
    rows = rows.withColumn("cls", F.when(usable, F.xxhash64("grp", "vector")))
    members = materialize(rows.select("id", "cls"), "vectors")
    classes = materialize(
        rows.where("cls IS NOT NULL").groupBy("cls").agg(
            F.first("grp").alias("grp"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least")),
        "vector-classes",
    )
    largest = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 1
    k = min(6, max(1, math.ceil(math.log(64 * largest, 128))))  # keys per vector stay few at any size
    stored = materialize(
        classes.select("cls", "grp", "vector").mapInArrow(_hash(k), "cls long, bucket long, own int")
        .groupBy("bucket", "cls").agg(F.max("own").alias("own")), "buckets",
    )
    buckets = stored.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 AND any = 1")
    parts = F.ceil(F.col("n") / UNIT).cast("int")
    placed = (
        stored.join(buckets.select("bucket", parts.alias("parts")), "bucket")
        .withColumn("part", F.pmod(F.xxhash64("cls", "bucket"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
        .withColumn("unit", F.xxhash64("bucket", "lo", "hi")).drop("parts", "other")
    )
    placed = materialize(placed, "units")
    bins = max(16, placed.count() // BIN_ROWS)
    found = materialize(
        placed.join(classes.select("cls", "grp", "vector", "copies"), "cls")
        .withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(bins)))
        .groupBy("bin", F.size("vector")).applyInArrow(_work(k), "cls long, links long, u long, v long"),
        "found",
    )
    links = found.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    tree = components(found.where("u IS NOT NULL").select("u", "v")).withColumnRenamed("node", "cls")
    named = classes.select("cls", "copies", "least").join(links, "cls", "left").join(tree, "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(
        "cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = members.join(named, "cls", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
